"""The order of op1's documents where ids are far apart, null or repeated, and its lanes against a plain version."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import fingerprints


@pytest.mark.parametrize("kind", ["outlier", "nulls", "repeats", "negative"])
def test_next_document(spark, kind, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 64)
    ids = {"outlier": [*range(400), 10**15], "nulls": [*range(200), *[None] * 200], "repeats": [*range(100), *[50] * 200, *range(100, 200)], "negative": [-(2**63), *range(-200, 200), 2**63 - 1]}[kind]
    rows = [(i, f"text number {k}\nof {k % 7}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r.n for r in fingerprints.with_next(df).where("ghost = 0").groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 60
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = {t: n for (_, t), (_, n) in zip(order, order[1:] + order[:1])}
    got = {r.text: r.next_text for r in fingerprints.with_next(df).where("ghost = 0").collect()}
    assert got == want
    digests = {r.edited_sha256 for r in fingerprints.fingerprint_edits(df).collect()}
    assert digests == {hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in want.items()}


def plain(spark, text):
    """The lanes by loops over Spark's own hashes."""
    paragraphs = text.split("\n")
    equal, near = np.zeros(2 * fingerprints.EQUAL_SEEDS, object), [0] * (2 * fingerprints.NEAR_SUMS)
    for p in paragraphs:
        w = p.split(" ")
        row = [F.xxhash64(F.lit(k), F.lit(p)) for k in range(fingerprints.EQUAL_SEEDS)]
        row += [F.xxhash64(*[F.lit(x).cast("string") for x in (*w[k : k + 3], None, None)[:3]]) for k in range(len(w))]
        h = [int(x) % 2**64 for x in spark.range(1).select(*row).first()]
        for k in range(fingerprints.EQUAL_SEEDS):
            equal[2 * k] = (equal[2 * k] + (h[k] >> 32)) % 2**32
            equal[2 * k + 1] = (equal[2 * k + 1] + h[k] % 2**32) % 2**32
        for x in h[fingerprints.EQUAL_SEEDS :]:
            for k in range(len(near)):
                near[k] += 1 if x >> k & 1 else -1
    return equal.tolist(), near


def test_lanes_and_likeness(spark):
    texts = ["one two three four\nfive six", "one two three four\nfive seven", "", "a\n" * 3 + "b b b b b b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r for r in fingerprints.fingerprints(df, ["k"]).collect()}
    want = [plain(spark, t) for t in texts]
    for k, (equal, near) in enumerate(want):
        assert got[k].equal == equal
        assert sorted(got[k].near) == sorted(near)
    pair = df.select(F.lit(1)).limit(1).select(*[F.array(*[F.lit(x) for x in got[k].near]).alias(f"n{k}") for k in (0, 1)])
    a, b = np.array(got[0].near, float), np.array(got[1].near, float)
    like = pair.select(fingerprints.likeness(F.col("n0"), F.col("n1"))).first()[0]
    assert abs(like - min(1, max(0, 2 * (a @ b) / (a @ a + b @ b)))) < 1e-12


def test_repeated_windows_do_not_wrap(spark):
    df = spark.createDataFrame([(1, "a b c\n" * 40_000), (2, "a b c\n" * 39_000)], "k int, text string")
    near = {r.k: np.array(r.near, float) for r in fingerprints.fingerprints(df, ["k"]).collect()}
    assert np.abs(near[1]).max() > 2**15 and 2 * (near[1] @ near[2]) / (near[1] @ near[1] + near[2] @ near[2]) > 0.99
