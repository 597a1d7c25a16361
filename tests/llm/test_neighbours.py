"""Nearest neighbours where norms differ, against brute force."""

import numpy as np
import pytest

from turnlake.llm import neighbours

R = np.random.default_rng(3)
CENTRES = R.normal(size=(60, 24))


def unit(n):
    x = CENTRES[R.integers(0, 60, n)] + 0.5 * R.normal(size=(n, 24))
    return x / np.sqrt((x * x).sum(1))[:, None]


def long_vector(x):
    return np.concatenate([x[:1] * 10, x[1:]])


def spread(x):
    return x * np.exp(R.normal(size=(len(x), 1)))


@pytest.mark.parametrize("change", [long_vector, spread])
def test_norms(spark, change):
    x = change(unit(6000))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df).toPandas()
    hits, queries = 0, range(0, len(x), 20)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        hits += (own.score >= np.sort(s)[-20] - 1e-9).sum()
    assert hits >= 0.95 * 20 * len(queries)


def test_queries_with_few_hits_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 500)
    monkeypatch.setattr(neighbours, "RECALL", 0.5)
    probes = neighbours.probes

    def blind(queries, hashed, sets):
        out = probes(queries, hashed, sets)
        if len(queries) == 75:
            out[:, :, :10] = -1
        return out

    monkeypatch.setattr(neighbours, "probes", blind)
    x = unit(1500)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 75
    for q in range(0, 200, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.argsort(-s)[:20].tolist()


def test_repeated_ids_and_lengths(spark):
    """Each distinct vector under a repeated id has its own list; vectors of two lengths are searched apart."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (40, [1.0, 1.0, 1.0]), (3, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.nearest(df).collect())
    assert got == sorted([(20, 1, 1, 2.0), (20, 2, 2, 0.0), (20, 1, 2, 3.0), (20, 2, 1, 0.0), (40, 1, 3, 2.0)])


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    x = unit(1600)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df).toPandas()
    assert got.query_id.nunique() == 80 and (got.groupby("query_id").size() == 20).all()
