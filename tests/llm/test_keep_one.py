"""Which rows near-dedup keeps where ids are null or repeated."""

import corpus_pipeline as P

A, B, C, D = (" ".join(f"{c}{k}" for k in range(60)) for c in "abcd")


def test_null_and_repeated_ids(spark):
    rows = [(None, A), (None, B), (None, B), (None, C), (5, C), (9, C.upper()), (7, D), (7, "other words " + A[:20]), (7, D)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in P.near_stage(spark, df, None).collect())
    assert got == sorted([(0, A), (0, B), (5, C), (7, D), (7, "other words " + A[:20])])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, A, 0.5, "x"), (2, A, None, "y"), (3, B, 1.0, None)], "doc_id long, text string, label double, fp string")
    got = P.near_stage(spark, df, None)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, A, 0.5, "x"), (3, B, 1.0, None)]
