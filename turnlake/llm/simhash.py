"""SimHash near-dedup with BK-trees.

A document's fingerprint takes, at each of 64 places, the majority of its shingles' hashes. Distinct fingerprints are then
linked at up to RADIUS differing bits. Two fingerprints that differ in so few bits agree on at least two of RADIUS + 2
blocks of bits, so each pair of blocks and its value (32 bits) names a shard; a shard's fingerprints form a BK-tree, whose children are keyed by their
integer Hamming distance to the parent, and a search follows only edges within the radius of a query's distance. A
shard beyond SHARD fingerprints is cut into subtrees, and each is sent to every block of queries of that shard.
A tree tells of each fingerprint only the least one that it is linked with, directly or by way of others in the tree, so a
dense group gives no pairs. Components follow by least labels over these stars, with written tables between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import materialise, skew_lookup, table

WORDS, SEED, RADIUS, BITS = 3, 42, 2, 64
SHARD = 512


def simhash(text: str, words: int = WORDS) -> int:
    """The unsigned fingerprint: ASCII letters lower-cased, words cut at ASCII white space, shingles with repeats; 0 without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    n = len(w) - words + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        end = min(n, at + 65536)
        own = map(b" ".join, zip(*(w[at + k : end + k] for k in range(words))))
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, end - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; null texts as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([simhash(t or "", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def distances(fps: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ one)


class BkTree:
    """nodes[i] = (fingerprint, {distance: child}); the first fingerprint is the root, as if they were inserted in order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.children: list[dict[int, int]] = [{} for _ in fps]
        waiting = [np.arange(len(fps))] if len(fps) else []
        while waiting:
            own = waiting.pop()
            d = distances(fps[own[1:]], fps[own[0]])
            for k in np.unique(d):
                part = own[1:][d == k]
                self.children[own[0]][int(k)] = int(part[0])
                waiting.append(part)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indices of the queries within the radius of it), all queries together from node to node."""
        waiting = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while waiting:
            node, own = waiting.pop()
            d = distances(queries[own], self.fps[node]).astype(np.int64)
            near = own[d <= radius]
            if len(near):
                yield node, near
            for k, child in self.children[node].items():
                follow = own[np.abs(d - k) <= radius]
                if len(follow):
                    waiting.append((child, follow))


def _stars(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its component) among the links of a tree with itself, or with other queries."""
    every = tree if queries is None else np.concatenate([tree, queries])
    offset = 0 if queries is None else len(tree)
    root = np.arange(len(every))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for node, near in BkTree(tree).search(every[offset:], radius):
        a = find(node)
        for q in near + offset:
            b = find(int(q))
            if a != b:
                root[max(a, b)] = min(a, b)
                a = min(a, b)
    tops = np.array([find(i) for i in range(len(every))])
    signed = every.view(np.int64)
    least = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(least, tops, signed)
    linked = np.bincount(tops, minlength=len(every))[tops] > 1
    return signed[linked], least[tops][linked]


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (block, value, i, j, side): trees of each shard, and the queries sent to them."""
        def solve(parts: list[tuple[np.ndarray, np.ndarray]], key: tuple) -> pa.RecordBatch:
            fps = np.concatenate([p[0] for p in parts]).view(np.uint64)
            side = np.concatenate([p[1] for p in parts])
            a, b = _stars(fps, None, radius) if key[2] == key[3] else _stars(fps[side == 0], fps[side == 1], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["fp", "least"])

        now, parts = None, []
        for batch in batches:
            keys = np.stack([np.array(batch.column(k), np.int64) for k in range(4)], axis=1)
            fps, side = np.array(batch.column(4), np.int64), np.array(batch.column(5), np.int64)
            if not len(fps):
                continue
            edges = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(fps)]])
            for at, end in zip(edges[:-1], edges[1:]):
                key = tuple(keys[at])
                if key != now and parts:
                    yield solve(parts, now)
                    parts = []
                now = key
                parts.append((fps[at:end], side[at:end]))
        if parts:
            yield solve(parts, now)

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, least: stars that join all fingerprints within the radius of each other. `distinct` has one row an fp; it is read twice."""
    blocks = radius + 2
    widths = [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]
    shifts = [sum(widths[:k]) for k in range(blocks)]
    values = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(shifts, widths)]
    pairs = [(a, b) for a in range(blocks) for b in range(a)]
    cut = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftleft(values[a], widths[b]).bitwiseOR(values[b]).alias("value")) for k, (a, b) in enumerate(pairs)])
    rows = distinct.select("fp", F.explode(cut).alias("x")).select("fp", "x.block", "x.value")
    sizes = materialise(rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
    total = distinct.count()
    key = F.xxhash64("block", "value").alias("key")
    main = rows.withColumn("key", key)
    found = skew_lookup(main, "key", sizes.select(key, F.col("n").alias("size")), sizes.select(key, "n"), len(pairs) * total)
    found = found.where("size is not null")
    parts = F.ceil(F.col("size") / F.lit(SHARD)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), F.col("fp")), F.col("parts")).cast("int")
    found = found.withColumn("parts", parts).withColumn("own", own)
    # Subtree `own` meets the queries of every other part j > own; (own, own) is the subtree with itself.
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"), (F.col("own") > j).cast("int").alias("side")))
    dealt = found.select("block", "value", F.explode(meet).alias("m"), "fp").select("block", "value", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "fp", F.col("m.side").alias("side"))
    # Rows are few bytes and much work, so their number decides how many tasks there are.
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, len(pairs) * total // 200_000)
    dealt = dealt.repartition(int(tasks), "block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j", "side", "fp")
    return dealt.mapInArrow(_shard_links(radius), "fp long, least long")


def components(stars: DataFrame, total: int) -> DataFrame:
    """fp, label: the least fp of each connected component of the stars (fp, least), by least labels and pointer jumps.

    Rounds are as many as the longest way from star to star has doublings, or few more; each is written."""
    edges = materialise(stars.where("fp <> least").distinct(), "stars")
    weights = materialise(edges.groupBy("least").agg(F.count(F.lit(1)).alias("n")), "star-sizes")
    nodes = edges.select("fp").union(edges.select(F.col("least").alias("fp"))).distinct()
    labels = materialise(nodes.withColumn("label", F.col("fp")), "labels")
    while True:
        # Each star's least label, its centre's among them, back to its points and its centre.
        at_points = edges.join(labels, "fp").select("least", "label")
        at_centres = weights.join(labels.withColumnRenamed("fp", "least"), "least").select("least", "label")
        star = at_points.union(at_centres).groupBy("least").agg(F.min("label").alias("star_label"))
        star = materialise(star, "star-labels")
        points = skew_lookup(edges, "least", star, weights, total).select("fp", F.col("star_label").alias("label"))
        centres = star.select(F.col("least").alias("fp"), F.col("star_label").alias("label"))
        new = points.union(centres).union(labels).groupBy("fp").agg(F.min("label").alias("label"))
        new = materialise(new, "labels")
        heavy = new.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = skew_lookup(new, "label", new.select(F.col("fp").alias("label"), F.col("label").alias("beyond")), heavy, total)
        jumped = materialise(jump.select("fp", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels")
        changed = jumped.join(labels.withColumnRenamed("label", "before"), "fp").where("label <> before").limit(1).count()
        labels = jumped
        if not changed:
            return labels


def near_groups(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links, its own included) of every row.

    Null texts and texts without words have fingerprint 0 and link like any other. Null doc_ids take part by their texts; a
    component of null ids alone has a null id. Empty table: no rows."""
    prints = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    total = max(1, prints.count())
    labels = components(links(distinct.select("fp"), radius), total)
    heads = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = heads.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows"))
    # Documents alone in their component need no lookup: only groups travel.
    groups = materialise(least.where("rows > 1"), "groups")
    ids = skew_lookup(heads.select("fp", "label", F.col("n").alias("copies")), "label", groups.select("label", "component_id"), groups.select("label", "n"), total)
    ids = materialise(ids.where("component_id is not null").select("fp", "component_id", "copies"), "members")
    got = skew_lookup(prints, "fp", ids.select("fp", "component_id"), ids.select("fp", F.col("copies").alias("n")), total)
    return got.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
