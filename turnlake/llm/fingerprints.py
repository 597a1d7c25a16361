"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

Each paragraph (line) is hashed into a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, lane
by lane, modulo powers of two. So order doesn't matter, and a paragraph is inserted or removed by adding or subtracting
its vector (`combine`). The vector has two parts:

* EQUAL lanes modulo 2^32: seeded 64-bit hashes of the whole paragraph, halved. Equal multisets have equal lanes.
* NEAR lanes modulo 2^32: for each window of three words that begins in the paragraph, plus or minus one by a bit of the
  window's hash. The squared length of such a sum estimates how many windows a document has, and that of a difference
  of two fingerprints how many windows differ, from which `likeness` (0 to 1) follows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.common import table

EQUAL_SEEDS = 4
NEAR_SUMS = 32
BUCKET_BYTES = 256 * 1024
#: Bounds of buckets on the driver and in the plan: numbers of 8 bytes, so a megabyte.
MAX_BUCKETS = 131_072
STEP = 512
_LOW = (1 << 32) - 1


def _sums() -> list[Column]:
    """Over one row per window `h` of paragraph `p`, where `at` is its place in the paragraph."""
    pair = F.lit((1 << 32) + 1)
    first = F.col("at") == 0
    out = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(pair)).alias(f"near{k}") for k in range(NEAR_SUMS)]
    for k in range(EQUAL_SEEDS):
        h = F.xxhash64(F.lit(k), F.col("p"))
        out.append(F.sum(F.when(first, h.bitwiseAND(F.lit(_LOW))).otherwise(F.lit(0))).alias(f"low{k}"))
        out.append(F.sum(F.when(first, F.shiftrightunsigned(h, 32)).otherwise(F.lit(0))).alias(f"high{k}"))
    return [*out, F.count(F.lit(1)).alias("windows")]


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, equal array<long>, near array<int>: the fingerprint of each key's text; keys must be unique.

    Null texts count as empty; an empty text is one empty paragraph. If `texts` is hash-partitioned by some of the keys,
    nothing is shuffled here."""
    rows = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("p"))
    rows = rows.withColumn("words", F.split("p", " "))
    windows = F.transform("words", lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    rows = rows.select(*keys, "p", F.posexplode(windows).alias("at", "h"))
    got = rows.groupBy(*keys).agg(*_sums())
    equal = F.array(*[F.col(f"{part}{k}").bitwiseAND(F.lit(_LOW)) for k in range(EQUAL_SEEDS) for part in ("high", "low")])
    packed = F.array(*[F.col(f"near{k}") for k in range(NEAR_SUMS)])

    def centred(ones: Column) -> Column:
        v = ones * 2 - F.col("windows") + (1 << 31)
        return (v.bitwiseAND(F.lit(_LOW)) - (1 << 31)).cast("int")

    near = F.concat(
        F.transform(packed, lambda s: centred(s.bitwiseAND(F.lit(_LOW)))),
        F.transform(packed, lambda s: centred(F.shiftrightunsigned(s, 32))),
    )
    return got.select(*keys, equal.alias("equal"), near.alias("near"))


def combine(a: Column, b: Column, sign: int = 1, bits: int = 32) -> Column:
    """Lane-wise a + b (sign 1: insert) or a - b (sign -1: delete) of EQUAL lanes, modulo 2^bits."""
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit((1 << bits) - 1)))


def as_text(equal: Column, near: Column) -> Column:
    """The fingerprint as lowercase hex: 64 digits of EQUAL lanes, then 8 digits of each NEAR lane."""
    words = [F.shiftleft(equal[2 * k], 32).bitwiseOR(equal[2 * k + 1]) for k in range(EQUAL_SEEDS)]
    for k in range(0, 2 * NEAR_SUMS, 2):
        words.append(F.shiftleft(near[k].cast("long"), 32).bitwiseOR(near[k + 1].cast("long").bitwiseAND(F.lit(_LOW))))
    return F.lower(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))


def likeness(a: Column, b: Column) -> Column:
    """2ab / (aa + bb) of NEAR lanes, held to 0..1: the estimated share of common windows."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    whole = dot(a, a) + dot(b, b)
    return F.when(a == b, F.lit(1.0)).when(whole == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * dot(a, b) / whole)))


def _place(bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above doc_id, in two steps of comparisons; -1 for null ids."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    parts = [bounds[k : k + STEP] for k in range(0, len(bounds), STEP)]
    heads = F.from_json(F.lit(json.dumps([p[0] for p in parts])), "array<bigint>")
    whole = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    head = F.size(F.filter(heads, lambda x: x <= F.col("doc_id")))
    own = F.size(F.filter(F.get(whole, head - 1), lambda x: x <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).when(head == 0, F.lit(0)).otherwise((head - 1) * STEP + own)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, bucket, rn, ghost: the next document in descending doc_id order, the first after the last.

    Ids are dealt to buckets by their quantiles, whatever gaps lie between them; an id with many rows (null among them) has
    buckets of its own, cut by the texts' hashes. So texts are shuffled once, and only equal texts under one id stay together.
    The first document of a bucket is also sent, as a ghost, to the bucket above it, where it follows the last one; the
    wrap-around is the same. Null ids come last, repeated ids in the order of their texts' hashes."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    s = d.agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    buckets = int(max(1, min(MAX_BUCKETS, (s["size"] or 0) // BUCKET_BYTES, s.n // 8)))
    cuts = d.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], min(1_000_000, 16 * buckets)).alias("q")).first().q if buckets > 1 else None
    cuts = cuts or []
    # An id that fills whole buckets begins and ends one.
    bounds = sorted(set(cuts) | {a + 1 for a, b in zip(cuts, cuts[1:]) if a == b < (1 << 63) - 1})
    most = max(8, s.n // buckets)
    d = d.withColumn("place", _place(bounds)).withColumn("hash", F.xxhash64("text"))
    crowds = d.groupBy("place").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 2 * most) & F.col("lo").eqNullSafe(F.col("hi")))
    # At most 2 * buckets places hold more than half a bucket's rows.
    cut = {r.place: -(-r.n // most) for r in crowds.select("place", "n").collect()}
    parts = F.coalesce(F.create_map(*[F.lit(int(x)) for kv in sorted(cut.items()) for x in kv])[F.col("place")], F.lit(1)) if cut else F.lit(1)
    part = F.least(parts - 1, F.floor((F.col("hash") / float(1 << 64) + 0.5) * parts).cast("int"))
    d = d.withColumn("part", part)
    # Order: ids descending (null last), then hashes. ~id falls as ids rise, and never overflows.
    key = F.struct(F.bitwise_not("doc_id").alias("i"), F.col("hash").alias("h"))
    tops = d.groupBy("place", "part").agg(F.min(key).alias("top")).collect()
    used = sorted(((r.place, r.part, r.top) for r in tops), key=lambda r: (-r[0], r[1]))
    rows = [(p, k, i, *used[i][2], (i - 1) % len(used)) for i, (p, k, _) in enumerate(used)]
    place = spark.createDataFrame(rows or [(0, 0, 0, None, 0, 0)], "_p int, _k int, bucket int, _i long, _h long, up int")
    d = d.join(F.broadcast(place), (F.col("place") == F.col("_p")) & (F.col("part") == F.col("_k")))
    first = F.bitwise_not("doc_id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_h"))
    here = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g"))
    d = d.withColumn("to", F.explode(F.when(first, F.array(here, F.struct(F.col("up").alias("b"), F.lit(1).alias("g")))).otherwise(F.array(here))))
    d = d.select("doc_id", "text", "hash", F.col("to.b").alias("bucket"), F.col("to.g").alias("ghost"))
    w = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "hash")
    return d.select("doc_id", "text", "bucket", "ghost", F.lead("text").over(w).alias("next_text"), F.row_number().over(w).alias("rn"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: fingerprints of every text and of its edited text, and their likeness."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Empty table: no rows. Null text: empty. One document: it is its own next. Repeated rows: a row each."""
    d = with_next(docs)
    n = F.length("text")
    d = d.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(coalesce(next_text, ''), 1, length(text) div 2)")))
    both = d.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    prints = fingerprints(both.select("bucket", "rn", F.col("x.kind").alias("kind"), F.col("x.t").alias("text")), ["bucket", "rn", "kind"])
    w = Window.partitionBy("bucket").orderBy("rn", "kind")
    pair = F.struct("equal", "near")
    prints = prints.select("bucket", "rn", "kind", "equal", "near", F.lead(pair).over(w).alias("e"), F.lead("near", 2).over(w).alias("next_near"))
    prints = prints.where("kind = 0").select(
        "bucket", "rn", as_text(F.col("equal"), F.col("near")).alias("fingerprint"), as_text(F.col("e.equal"), F.col("e.near")).alias("edited_fingerprint"),
        likeness(F.col("near"), F.col("e.near")).alias("near_edited"), likeness(F.col("near"), F.col("next_near")).alias("near_next"),
    )
    own = d.where("ghost = 0").select("bucket", "rn", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    return own.join(prints, ["bucket", "rn"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
