"""The pipeline's near-dedup: SimHash fingerprints in BK-trees, on five-word shingles, at a Jaccard similarity of 0.8.

Texts whose sets of shingles have a similarity of at least SIMILARITY are linked; groups are the connected components. Such
texts' fingerprints differ in up to RADIUS of 64 bits, too many for shards by blocks of bits (as in simhash.py), so shards
come from BANDS bands of ROWS minimum hashes: two texts of similarity 0.8 share no band with probability 5e-5, more similar
ones less often. Each bucket links its texts to its least one, so a dense bucket gives no pairs, and components of these stars
are the shards. A shard's fingerprints form a BK-tree; links that it finds are then decided on the shingles themselves.

A shard beyond GROUP texts or GROUP_BYTES is cut into blocks, each with a tree of its own, and its first text goes to every block:
texts linked to it, directly or by way of others, are one group at once. Only texts left over meet all other blocks.

Texts move once, to learn their shard and whether they are a copy; then only texts of shards with two or more move."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnlake.llm.common import materialise, skew_lookup, slices, small_batches
from turnlake.llm.simhash import BkTree, components

WORDS, BANDS, ROWS = 5, 25, 5
#: Bits that texts of similarity 0.8 may differ in: 10 are expected, with a deviation of 3.
RADIUS = 24
#: Texts and bytes of a block.
GROUP, GROUP_BYTES = 256, 4 << 20
#: The similarity as a fraction, so that it is compared in whole numbers.
SIMILARITY = (4, 5)
_r = np.random.default_rng(23)
_TIMES = _r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _r.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words as in simhash. A text under WORDS words is one shingle, one without words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = len(w) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for k in range(WORDS):
        s += h[k : k + n] * _PLACES[k]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def buckets(own: np.ndarray) -> np.ndarray:
    """One key a band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        part = own[None, at : at + 4096] ^ _FLIPS[:, None]
        part *= _TIMES[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def fingerprint(own: np.ndarray) -> np.uint64:
    """The SimHash of a set of shingles: at each bit, what more than half of them have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 65536):
        part = own[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(own), bitorder="little").view(np.uint64)[0]


def linked(sets: list[np.ndarray], known: list | None = None) -> np.ndarray:
    """The component of each set, as the least index in it. Sets of the same value of `known` are of one component already."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)

    first: dict = {}
    for i, name in enumerate(known or ()):
        join(i, first.setdefault(name, i))
    prints = np.array([fingerprint(s) for s in sets], np.uint64)
    for node, near in BkTree(prints).search(prints, RADIUS):
        n = len(sets[node])
        for j in near.tolist():
            m = len(sets[j])
            if j < node and SIMILARITY[0] * max(n, m) <= SIMILARITY[1] * min(n, m) and find(node) != find(j) and alike(sets[node], sets[j]):
                join(node, j)
    return np.array([find(i) for i in range(len(sets))], np.int64)


def _groups(solve: Callable[[tuple, list], pa.RecordBatch], keys: int) -> Callable:
    """Calls solve(key, rows) for each run of rows with equal first `keys` columns; rows come sorted by them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:keys] != now and rows:
                    yield solve(now, rows)
                    rows = []
                now = row[:keys]
                rows.append((*row[keys:-1], shingles(row[-1])))
        if rows:
            yield solve(now, rows)

    return run


def _stars(fps: list[bytes], top: np.ndarray) -> pa.RecordBatch:
    many = np.flatnonzero(np.bincount(top, minlength=len(top))[top] > 1)
    return pa.RecordBatch.from_arrays([pa.array([fps[i] for i in many], pa.binary()), pa.array([fps[top[i]] for i in many], pa.binary())], names=["fp", "least"])


def _first_pass(key: tuple, rows: list) -> pa.RecordBatch:
    fps = [r[0] for r in rows]
    return _stars(fps, linked([r[-1] for r in rows]))


def _second_pass(key: tuple, rows: list) -> pa.RecordBatch:
    """Rows (fp, group, shingles) of a block and of texts left over: links between different groups alone."""
    rows = list({r[0]: r for r in rows}.values())
    return _stars([r[0] for r in rows], linked([r[-1] for r in rows], [r[1] for r in rows]))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _marked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables. marks: fp, first (the tag of the row to keep), n, size, label (null: alone), blocks; one row a text that has
    copies or candidates. rows: fp, label, blocks, many, first, row: one row a text, but for rows that are equal in all columns."""
    small_batches(docs.sparkSession)
    every = [F.col(c) for c in docs.columns] + [F.col(c).isNull() for c in docs.columns]
    tag = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(*every).alias("a"), F.xxhash64(F.lit(77), *every).alias("b"))
    text = F.coalesce("text", F.lit(""))
    tagged = docs.select(text_key().alias("fp"), tag.alias("tag"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    schema = T.StructType([*tagged.schema.fields[:3], T.StructField("buckets", T.ArrayType(T.LongType()))])
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = pa.array([buckets(shingles(t)) for t in batch.column(3).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(kinds.field(1).type), batch.column(2), got], schema=kinds)

    texts = tagged.mapInArrow(bucketed, schema).groupBy("fp").agg(F.first("buckets").alias("buckets"), F.first("size").alias("size"), F.min("tag").alias("first"), F.count(F.lit(1)).alias("n"))
    texts = materialise(texts.withColumn("node", F.xxhash64("fp")), "texts")
    total = max(1, texts.agg(F.sum("n")).first()[0] or 0)
    # Nodes are 64-bit numbers: two texts that share one are at worst in one shard.
    rows = texts.select(F.col("node").alias("fp"), F.explode("buckets").alias("bucket"))
    sizes = materialise(rows.groupBy("bucket").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    stars = skew_lookup(rows, "bucket", sizes.select("bucket", "least"), sizes.select("bucket", "n"), BANDS * total, how="shuffle_hash")
    labels = components(stars.where("least is not null").select("fp", "least"), total)
    known = texts.drop("buckets").join(labels.select(F.col("fp").alias("node"), "label"), "node", "left").where("n > 1 or label is not null")
    known = materialise(known, "known")
    shards = materialise(known.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "shards")
    cut = shards.select("label", F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("bytes") / GROUP_BYTES), F.lit(1)).cast("int").alias("blocks"))
    marks = materialise(skew_lookup(known, "label", cut, shards.select("label", "n"), total), "marks")
    main = docs.select(text_key().alias("fp"), tag.alias("tag"), F.struct(*docs.columns).alias("row"))
    got = skew_lookup(main, "fp", marks.select("fp", "first", "label", "node", "blocks", F.lit(True).alias("found"), (F.col("n") > 1).alias("many")), texts.select("fp", "n"), total, how="shuffle_hash")
    got = got.where("found is null or tag = first").select("fp", "label", "node", "blocks", F.coalesce("many", F.lit(False)).alias("many"), "row")
    return marks, materialise(got, "rows")


def _dealt(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows by keys, in partitions of some megabytes whatever the planner thinks of small ones: the work is in the tasks."""
    at_least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(int(max(at_least, size // (8 << 20))), *keys).sortWithinPartitions(*keys, "fp")


def _dropped(marks: DataFrame, shards: DataFrame) -> DataFrame:
    """fp of all texts that aren't the one to keep of their group. `shards` has fp, label, node, blocks, text of all candidates."""
    total = max(1, marks.agg(F.sum("n")).first()[0] or 0)
    size = marks.where("label is not null").agg(F.sum("size")).first()[0] or 0
    own = F.pmod(F.xxhash64(F.lit(3), F.col("fp")), F.col("blocks")).cast("int")
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    # The shard's first text, whose node names it, goes to all blocks.
    sent = shards.select("label", F.explode(F.when(F.col("node") == F.col("label"), blocks).otherwise(F.array(own))).alias("block"), "fp", "text")
    stars = materialise(_dealt(sent, ["label", "block"], size).mapInArrow(_groups(_first_pass, 2), "fp binary, least binary"), "links")
    tops = components(stars, total)
    named = marks.where("label is not null").join(tops.withColumnRenamed("label", "top"), "fp", "left").select("fp", "label", "node", "blocks", "first", F.coalesce("top", "fp").alias("top"))
    named = materialise(named, "named")
    cut = named.where("blocks > 1")
    pivots = cut.where("node = label").groupBy("label").agg(F.min("top").alias("pivot"))
    weights = cut.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rest = materialise(skew_lookup(cut, "label", pivots, weights, total).where("top <> pivot").select("fp", "label"), "rest")
    over = materialise(rest.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts")), "rest-sizes")
    if over.limit(1).count():
        cut = skew_lookup(cut, "label", over, weights, total).where("parts is not null")
        cut = materialise(cut.join(rest.select("fp", F.lit(True).alias("left")), "fp", "left"), "again")
        text = shards.select("fp", "text").join(cut, "fp")
        part = F.pmod(F.xxhash64(F.lit(5), F.col("fp")), F.col("parts")).cast("int")
        at_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(own.alias("block"), k.alias("part")))
        abroad = F.transform(blocks, lambda k: F.struct(k.alias("block"), part.alias("part")))
        meet = text.select("label", F.explode(F.when(F.col("left"), F.concat(at_home, abroad)).otherwise(at_home)).alias("to"), "fp", "top", "text")
        meet = meet.select("label", "to.block", "to.part", "fp", "top", "text")
        more = materialise(_dealt(meet, ["label", "block", "part"], size).mapInArrow(_groups(_second_pass, 3), "fp binary, least binary"), "more-links")
        tops = components(stars.union(more), total)
        named = materialise(named.drop("top").join(tops.withColumnRenamed("label", "top"), "fp", "left").withColumn("top", F.coalesce("top", "fp")), "named")
    kept = named.groupBy("top").agg(F.min(F.struct("first", "fp")).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k.fp").alias("fp"), F.lit(True).alias("kept"))
    many = named.join(tops.select("fp"), "fp", "left_semi").select("fp")
    return many.join(kept, "fp", "left_anti")


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, one row of each group of near copies: the one with the least doc_id (null ids last), then by the
    row's hashes, so ids needn't be distinct or there at all. Null texts and texts without words are one group. Empty table:
    no rows. Columns may have any names."""
    marks, rows = _marked(docs)
    once = rows.where("not many").union(rows.where("many").dropDuplicates(["fp"]))
    shards = once.where("label is not null")
    drops = materialise(_dropped(marks, shards.select("fp", "label", "node", "blocks", F.col("row.text").alias("text"))), "dropped")
    out = once.where("label is null").union(shards.join(drops.hint("shuffle_hash"), "fp", "left_anti").select(*once.columns))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
