"""The pipeline against a plain version of each stage's decision, on the smallest tables."""


import corpus_pipeline as P
from turnlake.llm import language_id, simhash, toxicity

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in d.collect()}
    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "line_dedup", "near_dedup", "packing"]
    for name, stage in P.STAGES[:-1]:
        stage(spark, d, sf_dir).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == NAMES
        after = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            m = language_id.train(d)
            p = m.documents([r.text.encode() for r in before.values()]).max(1)
            assert set(after) == {k for k, s in zip(before, p) if s >= P.least_score(len(m.langs))}
        elif name == "toxicity":
            m = toxicity.train(d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert set(after) == {k for k, r in before.items() if m.score(r.text) < 0.5}
        elif name == "line_dedup":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
        else:
            groups = {}
            for k, r in sorted(before.items()):
                groups.setdefault(simhash.simhash(r.text), k)
            assert set(after) <= set(groups.values()) and len(after) >= 0.95 * len(groups)
        before, d = after, out
    packed = P.STAGES[-1][1](spark, d, sf_dir).toPandas()
    assert set(packed.doc_id) == set(before) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run_equals_its_stages(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert got.count() > 100 and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty(spark, tmp_path, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        d = stage(spark, d, sf_dir)
        assert d.count() == 0
