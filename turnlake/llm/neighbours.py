"""Approximate nearest neighbours: p-stable hashing with query-directed multiprobe.

Rows are parted by norm, a factor of 2^(1/4) a part. In a part, largest inner product is turned to least distance by one more
coordinate, sqrt(M^2 - |x|^2), with M the part's largest norm, and queries are scaled to norm M (their ranking stays). Each
of TABLES tables hashes a vector to floor((a.x + b) / w) for a few Gaussian directions a. A query's own bucket comes first;
then perturbed ones, in the order of the summed squared distances to the borders that are crossed (the estimated order of
success). Candidates of all tables are merged and ranked by exact inner products.

Parts of at most SAMPLE rows, and parts whose sample misses the wished recall with all probes, are searched exactly; so are
all rows for queries that found fewer than k.

The index isn't moved: each task hashes its own vectors, and the queries come in broadcast blocks of about BLOCK, one
block after the other, so the driver and the workers hold one block at a time.
Equal vectors are one entry (with their least ids: no more than the top k and the query's own can count)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.common import hash_fraction, materialise, shared_dir, table

K, EVERY = 20, 20
TABLES, RECALL = 10, 0.97
#: Bounds: queries in a broadcast block, vectors in the sample that sets the probes, vectors indexed by one task.
BLOCK, SAMPLE, SHARD = 16_384, 4_000, 65_536
#: Queries that try a part's probes, and norm parts (the last one holds all smaller norms).
ASKED, PARTS = 300, 32


def projections(width: int, tables: int, directions: int, cell: float, seed: int = 17) -> tuple[np.ndarray, np.ndarray, float]:
    r = np.random.default_rng(seed)
    return r.normal(size=(tables, width, directions)), r.uniform(0, cell, (tables, directions)), cell


def keys(cells: np.ndarray) -> np.ndarray:
    """Bucket keys of cell vectors (..., directions)."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for k in range(cells.shape[-1]):
        out = (out ^ (cells[..., k].astype(np.int64) & 0xFFFF)) * np.int64(0x100000001B3 + 2)
    return out


def perturbations(directions: int, most: int) -> list[tuple[int, ...]]:
    """Sets of ranks 0..2D-1 (the D nearer borders' order) in ascending expected cost; a direction is moved one way at most.

    Ranks stand for borders sorted by distance; the expected squared distance of rank j of D uniform offsets is known, so
    one order serves all queries, as in query-directed probing with precomputed expected scores."""
    import heapq

    d2 = 2 * directions
    cost = [(j + 1) * (j + 2) / (4 * (directions + 1) * (directions + 2)) if j < directions else 1 - (d2 - j) / (directions + 1) + (d2 - j) * (d2 - j + 1) / (4 * (directions + 1) * (directions + 2)) for j in range(d2)]
    found, heap = [()], [(cost[0], (0,))]
    while heap and len(found) < most:
        c, s = heapq.heappop(heap)
        if all(d2 - 1 - j not in s for j in s):
            found.append(s)
        last = s[-1]
        if last + 1 < d2:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], s[:-1] + (last + 1,)))
            heapq.heappush(heap, (c + cost[last + 1], (*s, last + 1)))
    return found


def probes(queries: np.ndarray, hashed: tuple, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Bucket keys (tables, probes, queries), the likeliest first."""
    a, b, w = hashed
    out = np.empty((a.shape[0], len(sets), len(queries)), np.int64)
    for t in range(a.shape[0]):
        x = (queries @ a[t] + b[t]) / w
        cell = np.floor(x)
        near = x - cell
        # 2D moves, down by the distance to the lower border, up by that to the upper one; j-th and (2D-1-j)-th are opposite.
        dist = np.concatenate([near, 1 - near], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        d = a.shape[2]
        for p, s in enumerate(sets):
            moved = cell.copy()
            for j in s:
                m = order[:, j]
                np.add.at(moved, (np.arange(len(queries)), m % d), np.where(m < d, -1, 1))
            out[t, p] = keys(moved)
    return out


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products whose rounding depends on the two vectors alone."""
    return (x * q).sum(axis=1)


def _ranked(found: np.ndarray, scores: np.ndarray, sorted_ids: np.ndarray, starts: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k (vec_ids, scores) of some distinct vectors, each with its ids ascending in `sorted_ids`; the query's own id is none."""
    lo, hi = starts[found], starts[found + 1]
    if len(found) and (hi - lo).max() > 1:
        lists = []
        for first, last in zip(lo, hi):
            same = sorted_ids[first:last]
            at, past = np.searchsorted(same, own, "left"), np.searchsorted(same, own, "right")
            lists.append(np.concatenate([same[: min(at, k)], same[past : past + k]])[:k])
        got_ids, got = np.concatenate(lists), np.repeat(scores, [len(x) for x in lists])
    else:
        got_ids, got = sorted_ids[lo], scores
        got_ids, got = got_ids[got_ids != own], got[got_ids != own]
    best = np.lexsort((got_ids, -got))[:k]
    return got_ids[best], got[best]


def search_shard(ids: np.ndarray, x: np.ndarray, top_norm: float, query_ids: np.ndarray, queries: np.ndarray, probe_keys: np.ndarray, hashed: tuple, k: int) -> Iterator[tuple]:
    """(query's place, vec_ids, scores) of the best k candidates of this shard for each query that has any. The work for a query
    is in its probes and candidates, not in the shard's rows."""
    a, b, w = hashed
    rows, inverse = np.unique(x, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    order = np.lexsort((ids, inverse))
    starts = np.searchsorted(inverse[order], np.arange(len(rows) + 1))
    wide = np.concatenate([rows, np.sqrt(np.maximum(0, top_norm**2 - (rows * rows).sum(1)))[:, None]], axis=1)
    buckets = []
    for t in range(a.shape[0]):
        own = keys(np.floor((wide @ a[t] + b[t]) / w))
        by = np.argsort(own, kind="stable")
        buckets.append((own[by], by))
    entries, sorted_ids, marked = np.concatenate([by for _, by in buckets]), ids[order], np.zeros(len(rows), bool)
    for i in range(len(queries)):
        if i % 256 == 0:  # the buckets' bounds in `entries`, for some queries at a time
            block = probe_keys[:, :, i : i + 256]
            lo, hi = (np.stack([np.searchsorted(own, block[t], side) + t * len(rows) for t, (own, _) in enumerate(buckets)]) for side in ("left", "right"))
            size = hi - lo
        a, n = lo[:, :, i % 256].ravel(), size[:, :, i % 256].ravel()
        a, n = a[n > 0], n[n > 0]
        if not len(n):
            continue
        tried = entries[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
        if 8 * len(tried) < len(rows):
            found = np.unique(tried)
        else:  # marking rows costs less than sorting candidates
            marked[tried] = True
            found = np.flatnonzero(marked)
            marked[found] = False
        rough = rows[found] @ queries[i]
        if len(found) > 2 * k + 2:
            found = found[np.argpartition(-rough, 2 * k + 1)[: 2 * k + 2]]
        yield i, *_ranked(found, _exact(rows[found], queries[i]), sorted_ids, starts, query_ids[i], k)


def search_exact(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple]:
    """As search_shard, with every row a candidate."""
    rows, inverse = np.unique(x, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    order = np.lexsort((ids, inverse))
    starts, sorted_ids = np.searchsorted(inverse[order], np.arange(len(rows) + 1)), ids[order]
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ rows.T
        for i in range(len(rough)):
            found = np.argpartition(-rough[i], 2 * k + 1)[: 2 * k + 2] if len(rows) > 2 * k + 2 else np.arange(len(rows))
            yield at + i, *_ranked(found, _exact(rows[found], queries[at + i]), sorted_ids, starts, query_ids[at + i], k)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double>, norm: rows with an id whose vector is there, not empty, not zero, with finite components only."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where("vec_id is not null and v is not null and size(v) > 0").where(fine)
    return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).where("norm > 0")


def scaled(queries: np.ndarray, top_norm: float) -> np.ndarray:
    """The queries at norm top_norm, with the added coordinate of zero: their distances depend on inner products alone."""
    norms = np.sqrt((queries * queries).sum(1))[:, None]
    return np.concatenate([queries * (top_norm / norms), np.zeros((len(queries), 1))], axis=1)


def tune(sample: np.ndarray, total: int, top_norm: float, k: int = K, recall: float = RECALL, asked: np.ndarray | None = None) -> tuple[tuple, list[tuple[int, ...]], float]:
    """Directions by the logarithm of `total`, cell width by the sample's spread, as many probes as reach `recall` on the
    sample, and the recall there (`asked` are queries, or else the sample's own rows; nearest neighbours by brute force)."""
    wide = np.concatenate([sample, np.sqrt(np.maximum(0, top_norm**2 - (sample * sample).sum(1)))[:, None]], axis=1)
    directions = int(np.clip(round(np.log2(max(2, total)) / 2) - 3, 2, 12))
    spread = float(np.std(wide - wide.mean(0)) * np.sqrt(1))
    cell = max(1e-9 * top_norm, 1.6 * spread * np.sqrt(wide.shape[1]) / 1.0)
    hashed = projections(wide.shape[1], TABLES, directions, cell)
    sets = perturbations(directions, min(3**directions, 160))
    n = len(sample)
    if asked is None:
        own = np.arange(n) if n <= 300 else np.random.default_rng(1).choice(n, 300, replace=False)
        asked = sample[own]
        scores = asked @ sample.T
        scores[np.arange(len(own)), own] = -np.inf
        n -= 1
    else:
        scores = asked @ sample.T
    # A row's k-th neighbour among `total` is nearer than among the sample: the share of its k stays the same.
    take = max(1, min(k, n))
    best = np.argpartition(-scores, take - 1, axis=1)[:, :take] if n > 0 else np.zeros((len(asked), 0), int)
    tried = probes(scaled(asked, top_norm), hashed, sets)
    of = np.stack([keys(np.floor((wide @ hashed[0][t] + hashed[1][t]) / cell)) for t in range(TABLES)])
    first = np.full(best.shape, len(sets))
    for t in range(TABLES):
        for p in range(len(sets)):
            hit = of[t][best] == tried[t, p][:, None]
            first = np.where(hit & (first > p), p, first)
    flat = np.sort(first.reshape(-1))
    if not len(flat):
        return hashed, sets, 0.0
    need = int(flat[min(len(flat) - 1, int(np.ceil(recall * len(flat))) - 1)])
    sets = sets[: need + 1]
    return hashed, sets, float((flat < len(sets)).mean())


FOUND = "asked long, query_id long, vec_id long, score double"


def _searched(index: DataFrame, d: int, block: tuple, k: int, top: float = 0.0, hashed: tuple | None = None, sets: list | None = None) -> tuple[DataFrame, Broadcast]:
    """Each task's best k rows of `index` for each query of a block (asked, ids, vectors): by probes, or exactly without
    `hashed`. And the broadcast, to be destroyed once the rows are written."""
    asked, query_ids, queries = block
    probe_keys = None if hashed is None else probes(scaled(queries, top), hashed, sets)
    shared = index.sparkSession.sparkContext.broadcast((asked, query_ids, queries, probe_keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, query_ids, queries, probe_keys = shared.value
        ids, vs, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            x, own = np.concatenate(vs), np.concatenate(ids)
            found = search_exact(own, x, query_ids, queries, k) if hashed is None else search_shard(own, x, top, query_ids, queries, probe_keys, hashed, k)
            part = []
            for one in found:
                part.append(one)
                if len(part) == 2000:
                    yield batch_of(part)
                    part = []
            if part:
                yield batch_of(part)

        def batch_of(part: list[tuple]) -> pa.RecordBatch:
            at = np.concatenate([np.full(len(v), i) for i, v, _ in part])
            return pa.RecordBatch.from_pydict({"asked": asked[at], "query_id": query_ids[at], "vec_id": np.concatenate([v for _, v, _ in part]), "score": np.concatenate([s for _, _, s in part])})

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(np.array(batch.column(0), np.int64))
            vs.append(np.array(batch.column(1).flatten(), np.float64).reshape(-1, d))
            held += batch.num_rows
            if held >= SHARD:
                yield from flush()
                ids, vs, held = [], [], 0
        if held:
            yield from flush()

    return index.mapInArrow(run, FOUND), shared


def _blocks(queries: DataFrame, count: int, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """At most about BLOCK queries at a time reach the driver."""
    blocks = -(-count // BLOCK)
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(F.lit(4), F.col("asked")), F.lit(blocks)) == block).dropDuplicates().toPandas().sort_values(["vec_id", "asked"], kind="stable")
        if len(own):
            yield own.asked.to_numpy(), own.vec_id.to_numpy(), np.array(own.v.tolist(), np.float64).reshape(-1, d)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _of_length(good: DataFrame, d: int, n: int, top: float, q: int, k: int, every: int) -> DataFrame:
    """asked, query_id, rank, vec_id, score: `nearest` among the `n` vectors of length d, of which `q` ask."""
    spark = good.sparkSession
    path = f"{shared_dir(spark)}/neighbours-{uuid.uuid4().hex}"
    # The top of the first part lies half a step above the largest norm, so that equal norms with rounding are one part.
    part = F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor(F.lit(0.5) - F.log2(F.col("norm") / F.lit(top)) * 4))).cast("int")
    good = good.where(F.size("v") == d).select("vec_id", "v", part.alias("part"), "norm", F.xxhash64("vec_id", "v").alias("asked"))
    sample = good.where(hash_fraction(F.col("vec_id"), 22) < min(1.0, ASKED / n)).select("v").toPandas()
    asked = np.array(sample.v.tolist(), np.float64).reshape(-1, d)
    tuned, plain = {}, []
    for r in good.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy("part").collect():
        if r.n > SAMPLE:
            sample = good.where((F.col("part") == r.part) & (hash_fraction(F.col("vec_id"), 21) < min(1.0, SAMPLE / r.n))).select("v").toPandas()
            sample = np.array(sample.v.tolist(), np.float64).reshape(-1, d)
            hashed, sets, reached = tune(sample, r.n, r.top, k, asked=None if r.n == n else asked) if len(sample) > 1 else (None, None, 0.0)
            if reached >= RECALL:
                tuned[r.part] = (r.top, hashed, sets)
                continue
        plain.append(r.part)
    shards = max(spark.sparkContext.defaultParallelism, -(-n // SHARD))

    def of_parts(own: list[int]) -> DataFrame:
        return (good.where(F.col("part").isin(own)) if len(own) < len(tuned) + len(plain) else good).select("vec_id", "v").coalesce(shards)

    def write(block: tuple, exact: list[int], by_probes: dict) -> None:
        """A block's searches, ranked and written before the next block comes: one block's broadcasts are held at a time."""
        searched = [_searched(of_parts([p]), d, block, k, *found) for p, found in by_probes.items()]
        if exact:
            searched.append(_searched(of_parts(exact), d, block, k))
        _best(reduce(DataFrame.union, [s for s, _ in searched]), k).write.mode("append").parquet(path)
        for _, shared in searched:
            shared.destroy()

    queries = good.where(F.col("vec_id") % every == 0).select("asked", "vec_id", "v")
    for block in _blocks(queries, q, d):
        write(block, plain, tuned)
    schema = FOUND + ", rank int"
    if tuned:
        found = spark.read.schema(schema).parquet(path)
        full = materialise(found.groupBy("asked").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("asked"), "full-queries")
        short = materialise(queries.join(full, "asked", "left_anti"), "short-queries")
        done, path = found.join(full, "asked", "left_semi").select(*found.columns), f"{path}-short"
        count = short.count()
        for block in _blocks(short, count, d):
            write(block, [*plain, *tuned], {})
        return done.union(spark.read.schema(schema).parquet(path)) if count else done
    return spark.read.schema(schema).parquet(path)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every`, its k nearest found by inner product.

    Ties go to the smaller vec_id; a row's copies under other ids are candidates, rows under the query's own id aren't.
    Vectors are compared with those of their own length. Repeated ids: a list of k for each distinct vector under the id.
    Fewer than k candidates: all of them. Empty table: no rows."""
    good = usable(vectors)
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.count_if(F.col("vec_id") % every == 0).alias("q")).where("q > 0").orderBy("d").collect()
    found = [_of_length(good, r.d, r.n, r.top, r.q, k, every) for r in lengths]
    found = found or [vectors.sparkSession.createDataFrame([], FOUND + ", rank int")]
    return reduce(DataFrame.union, found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
