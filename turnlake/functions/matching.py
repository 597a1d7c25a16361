"""Column functions and small operators that match texts, paths, patterns and hashes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TOKEN = r"\[\[[0-9a-f]{8}\]\]"
#: Positions of a hash in the filter.
BLOOM_HASHES = 7


def short_hash(text: Column) -> Column:
    """XXH64 with seed 0 of the UTF-8 bytes, 16 lower-case hex digits; null stays. Spark's own xxhash64 has another seed."""
    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        import xxhash

        return pa.array([None if t is None else xxhash.xxh64_hexdigest(t.encode()) for t in texts.to_pylist()], pa.string())

    return run(text)


def only_tokens_differ(old: Column, new: Column) -> Column:
    """Whether `new` holds a placeholder and the texts between its placeholders stand in `old` in their order."""
    def step(rest: Column, part: Column) -> Column:
        at = F.call_function("locate", part, rest)
        return F.when(part == "", rest).when(at > 0, F.substring(rest, at + F.length(part), F.length(rest)))

    rest = F.aggregate(F.split(new, TOKEN, -1), old, step)
    return new.rlike(TOKEN) & rest.isNotNull()


def mentions_path(path: Column, text: Column) -> Column:
    """Whether the path stands in the text, with slashes of either kind, not within a longer name."""
    edge = "[A-Za-z0-9_-]"

    def one(p: Column) -> Column:
        return F.rlike(text, F.concat(F.lit(f"(?<!{edge})\\Q"), p, F.lit(f"\\E(?!{edge})")))

    return (path != "") & (one(path) | one(F.replace(path, F.lit("/"), F.lit("\\"))))


def matches_run(steps: Column, actions: Column) -> Column:
    """Whether the steps stand in the actions one after the other, each containing its action or contained in it."""
    n, k = F.size(actions), F.size(steps)
    like = lambda a, b: a.contains(b) | b.contains(a)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - k))
    return (k > 0) & (n >= k) & F.exists(starts, lambda s: F.forall(F.sequence(F.lit(0), k - 1), lambda j: like(F.get(actions, s + j), F.get(steps, j))))


def longest_first(tokens: Column) -> Column:
    """Distinct tokens by descending length, then by text: the order in which they are put back."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(tokens), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])


def union_of(*lists: Column) -> Column:
    """Several extractors' candidates, sorted, each once."""
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def clamp(asked: Column, least: int, most: int, default: int) -> Column:
    """A limit that a caller asked for, within its bounds; the default where none was asked for."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(asked, F.lit(default))))


def bloom_positions(h: Column, bits: int) -> Column:
    """Double hashing: BLOOM_HASHES places of a 64-bit hash, modulo the filter's bits; nothing overflows."""
    a, b = F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 17).bitwiseOR(F.lit(1)), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(BLOOM_HASHES - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)))


def bloom(rows: DataFrame, h: str, bits: int) -> DataFrame:
    """at: the set bits, one row each; at most `bits` rows, whatever the input."""
    return rows.select(F.explode(bloom_positions(F.col(h), bits)).alias("at")).distinct()


def may_contain(rows: DataFrame, key: str, h: str, filled: DataFrame, bits: int) -> DataFrame:
    """key, maybe: whether all of the hash's bits are set. An equi-join on the bit, counted by key."""
    at = rows.select(key, F.explode(F.array_distinct(bloom_positions(F.col(h), bits))).alias("at"))
    return at.join(filled.withColumn("_set", F.lit(1)), "at", "left").groupBy(key).agg((F.count("_set") == F.count(F.lit(1))).alias("maybe"))


def samples(part: Column, size: int) -> Column:
    """Distinct substrings of `size` characters at a chunk's start, middle and end; the whole chunk where it is shorter."""
    n = F.length(part)
    cut = lambda at: F.substring(part, at, F.lit(size))
    return F.array_distinct(F.array(cut(F.lit(1)), cut(F.greatest(F.lit(1), F.floor((n - size) / 2).cast("int") + 1)), cut(F.greatest(F.lit(1), n - size + 1))))


def findings(events: DataFrame, run: str, scan: Callable[[Column], Column]) -> DataFrame:
    """run, finding: the distinct findings of a scanner (a text column to a finding or null) on a run's actions."""
    return events.where("kind = 'action'").select(run, scan(F.col("summary")).alias("finding")).where("finding is not null").distinct()


def ask(rows: DataFrame, system: str, prompt: str, complete: Callable[[str, str], str], attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """All rows and `answer`: what a caller's own client says to each prompt; null where every attempt fails. Off unless called.

    Waits double from one attempt to the next. The client is made by the caller and must be picklable."""
    def one(a: str, b: str) -> str | None:
        for k in range(attempts):
            try:
                return complete(a, b)
            except Exception:  # noqa: BLE001 - any fault of a caller's client is a failed attempt
                if k + 1 < attempts:
                    time.sleep(wait * 2**k)
        return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(answer=[one(a, b) for a, b in zip(part[system], part[prompt])])

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))
