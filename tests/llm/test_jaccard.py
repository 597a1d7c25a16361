"""The pipeline's near-dedup against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from turnlake.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts):
    """The group of each text, by brute force."""
    sets, top = [plain(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    return top


@pytest.fixture(scope="module")
def planted():
    """Texts of many lengths, and copies with a few words changed: similarities on both sides of 0.8, and chains."""
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(n)) for n in [3, 5, 8, 40, 90, 150, 300, 700] * 4]
    for k in range(32):
        own = texts[k].split()
        for step in range(5):
            for _ in range(1 + len(own) // r.choice([60, 90, 150])):
                own[r.randrange(len(own))] = f"w{r.randrange(3000)}"
            texts.append(" ".join(own) if step % 2 else " ".join(own).upper())
    return texts + ["", " \n", None]


def test_near_copies(spark, planted):
    df = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(planted)], SCHEMA)
    top = groups(planted)
    assert 40 < len(set(top)) < len(top) - 40
    got = P.near_stage(spark, df, None).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(top))


def test_links_without_candidates(planted):
    assert jaccard.linked([jaccard.shingles(t) for t in planted]).tolist() == groups(planted)


def test_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = df.collect()
    top = groups([r.text for r in rows])
    got = P.near_stage(spark, df.orderBy(F.rand()), sf_dir).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted({rows[k].doc_id for k in top})


def test_cut_shards(spark, planted, monkeypatch):
    """Shards far beyond a block: texts linked to the first one, texts left over, and the same groups as without blocks."""
    monkeypatch.setattr(jaccard, "GROUP", 4)
    r = random.Random(9)
    base = [f"b{r.randrange(500)}" for _ in range(200)]
    chain = [list(base)]
    for _ in range(40):
        nxt = list(chain[-1])
        for _ in range(5):
            nxt[r.randrange(200)] = f"c{r.randrange(9000)}"
        chain.append(nxt)
    texts = [" ".join(t) for t in chain] + planted
    df = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], SCHEMA)
    got = P.near_stage(spark, df, None).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(groups(texts)))
