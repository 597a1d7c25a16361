"""The pipeline's line dedup on hosts of few pages."""

import corpus_pipeline as P


def test_small_hosts(spark):
    rows = [(k, f"Menu | home\nown line {k}", "en", host, 1) for host, ids in (("nine", range(9)), ("two", range(9, 11)), ("one", range(11, 12))) for k in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.line_stage(spark, df, None).collect()}
    assert got == {k: t.split("\n")[1] if k < 11 else t for k, t, *_ in rows}
