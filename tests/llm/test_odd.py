"""Every query on empty tables, every stage and operator on odd rows, clashing names and a text of megabytes."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline as P
from turnlake.llm import fingerprints, jaccard, language_id, line_dedup, neighbours, packing, quality, queries, simhash, toxicity, warc

TABLES = ["documents", "embeddings", "pages", "labels", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, sf_dir, empty_dir, name):
    got = queries.QUERIES[name](spark, empty_dir)
    assert got.collect() == [] and got.columns


#: Names that operators add, look up or use inside; all are columns of the odd table too.
CLASHES = "lang_pred lang_score toxic_score quality_score lines_dropped label fp _kept _y _id n h key bucket rn kind piece length offset sequence_id words line part place hash".split()


@pytest.fixture(scope="module")
def clashing(spark, odd_docs, sf_dir):
    """Rows of the smallest table among the odd ones, and columns of every name above."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(d.where("doc_id >= 100"))
    return rows.select("*", *[F.lit(f"was {c}").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_on_odd_rows(spark, sf_dir, clashing, name):
    """Columns, their values and the order of columns stay; of the odd rows go those that the stage's docstring names."""
    got = dict(P.STAGES)[name](spark, clashing, sf_dir)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert rows and all(r[c] == f"was {c}" for r in rows for c in CLASHES)
    n = clashing.count()
    texts = [r.text for r in rows if r.doc_id is None or r.doc_id < 100]
    if name == "language_id":
        assert not {None, "", " \n\t ", "123 456 !!"} & set(texts) and "No id at all, but words" in texts
    elif name == "line_dedup":
        assert len(rows) == n and texts.count(None) == 1
    elif name == "toxicity":
        assert len(texts) == 10
    else:
        assert len(texts) == len(set(texts)) == 6 and sum(not (t or "").strip() for t in texts) == 1 and "No id at all, but words" in texts


def test_packing_of_odd_rows(spark, clashing, sf_dir):
    got = P.STAGES[-1][1](spark, clashing, sf_dir).toPandas()
    assert got.columns.tolist() == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert (got.piece == 0).sum() == clashing.count() and got.groupby("sequence_id").length.sum().max() <= 2048


def test_repeated_pages(spark, tmp_path):
    """Repeated rows are records of their own; of equal payloads one row of the largest id is the response."""
    rows = [(4, "u", "x" * 1000)] * 3 + [(2, "v", "x" * 1000), (7, "w", "short")] + [(7, "w", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    at = f"file://{tmp_path}/w"
    got = warc.read_archives(warc.write_archives(pages, at), at).collect()
    assert len(got) == 6 and sorted(r.page_id for r in got) == [2, 4, 4, 4, 7, 7]
    assert all(r.refers_to == 4 for r in got if r.record_type == "revisit") and [r.record_type for r in got if r.page_id == 2] == ["revisit"]
    assert all(r.payload_digest == hashlib.sha1(("short" if r.page_id == 7 else "x" * 1000).encode()).hexdigest() for r in got)


@pytest.fixture(scope="module")
def very_long(spark):
    """Two megabytes of lines and words, one of them a word without an end, beside a short text."""
    text = "\n".join(f"line {k} has words of its own number {k * 7919}" for k in range(30_000)) + " " + "x" * 400_000
    return spark.createDataFrame([(1, text, "a"), (2, "A short text, an idiot's.", "a"), (3, text, "b")], "doc_id long, text string, source string").repartition(1)


def test_very_long_texts(spark, very_long):
    rows = very_long.collect()
    prints = {r.doc_id: r for r in fingerprints.fingerprint_edits(very_long).collect()}
    assert prints[1].fingerprint == prints[3].fingerprint != prints[2].fingerprint and prints[1].n_chars == len(rows[0].text)
    lang = {r.doc_id: r for r in language_id.predict(very_long, language_id.ByteGru(["a", "b"])).collect()}
    assert lang[1].lang_score == lang[3].lang_score and 0.5 <= lang[1].lang_score <= 1
    tox = {r.doc_id: r.toxic_score for r in toxicity.score(very_long, toxicity.fit([])[0]).collect()}
    assert tox[1] == tox[3] < 0.5 < tox[2]
    good = {r.doc_id: r.quality_score for r in quality.score(very_long, *quality.fit([("line has words", 1), ("an idiot", 0)])).collect()}
    assert good[1] == good[3] > good[2]
    assert {r.doc_id: r.component_id for r in simhash.near_groups(very_long).collect()} == {1: 1, 2: 2, 3: 1}
    assert sorted(r.doc_id for r in jaccard.keep_one(very_long).collect()) == [1, 2]
    packed = packing.pack_documents(very_long).toPandas()
    by = packed.groupby("doc_id").length.sum()
    assert by[1] == by[3] > 100_000 and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert {r.doc_id: r.lines_dropped for r in line_dedup.drop_lines(very_long.withColumn("source", F.lit("a"))).collect()} == {1: 30_000, 2: 0, 3: 30_000}


def test_neighbours_with_extra_columns(spark):
    """Columns named as results are; nulls, zeros and odd components take no part."""
    rows = [(k, [float(k % 7), 1.0, float(k % 3)], "was rank") for k in range(0, 60)] + [(80, None, None), (100, [0.0] * 3, ""), (120, [float("nan"), 1.0, 1.0], "")]
    kind = T.ArrayType(T.FloatType())
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", kind), T.StructField("rank", T.StringType())]))
    df = df.withColumn("score", F.lit(1)).withColumn("query_id", F.lit(5))
    got = neighbours.nearest(df).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and len(got) == 60
    vec = {k: v for k, v, _ in rows[:60]}
    for q in (0, 20, 40):
        want = sorted((-sum(a * b for a, b in zip(vec[q], v)), k) for k, v in vec.items() if k != q)[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(k, -s) for s, k in want]

