"""What upserts, caps, retention, merges and splits leave in a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(rows: DataFrame, time: str, key: str, most: int) -> DataFrame:
    """The newest `most` rows: a top-k, so no task sorts the whole table."""
    return rows.orderBy(F.desc(time), key).limit(most)


def upsert(rows: DataFrame, key: str, order: list[str], latest: list[str], earliest: list[str], seen: str) -> DataFrame:
    at = F.struct(*order)
    return rows.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in latest], *[F.min_by(c, at).alias(c) for c in earliest], F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def replay_outcomes(audits: DataFrame, ledger: DataFrame, key: str, failed: Column, empty: Column) -> DataFrame:
    done = ledger.select(F.col(key).alias("_done")).distinct()
    a = audits.join(done, F.col(key) == F.col("_done"), "left")
    return a.withColumn("outcome", F.when(F.col("_done").isNotNull(), "processed").when(failed, "failed").when(empty, "no body").otherwise("submitted")).drop("_done")


def snapshots(bodies: DataFrame, cap: int, preview: int = 8192) -> DataFrame:
    """Bodies cut at a cap held to 1 KiB..20 MiB, with sizes and a preview."""
    cap = max(1 << 10, min(cap, 20 << 20))
    n = F.octet_length("body").cast("long")
    return bodies.select(*[c for c in bodies.columns if c != "body"], n.alias("bytes"), F.least(n, F.lit(cap)).cast("long").alias("saved"), (n > cap).alias("truncated"), F.substring("body", 1, cap).alias("body"), F.substring("body", 1, min(cap, preview)).alias("preview"))


def within_size(rows: DataFrame, time: str, key: str, size: str, most: int) -> DataFrame:
    """The newest rows whose running size stays within `most`.

    Totals of coarse time slices come first, so only the slices that can still fit are put in one order: a slice whose
    newer slices alone exceed the cap is dropped before the window."""
    width = 3_600_000_000
    s = rows.withColumn("_slice", F.floor(F.col(time) / width).cast("long"))
    sums = s.groupBy("_slice").agg(F.sum(size).alias("_sum"))
    w = Window.orderBy(F.desc("_slice"))
    newer = sums.withColumn("_newer", F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("_newer", F.lit(0)) <= most).select("_slice")
    own = s.join(F.broadcast(newer), "_slice", "left_semi")
    total = F.sum(size).over(Window.orderBy(F.desc(time), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("total", total).where(F.col("total") <= most).drop("_slice")


def sequenced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def merge_runs(rows: DataFrame, agent: str, run: str, sources: list[int], target: int, key: str) -> DataFrame:
    m = rows.withColumn("_old", F.col(run)).withColumn(run, F.when(F.col(run).isin(sources), F.lit(target)).otherwise(F.col(run)).cast("long"))
    w = Window.partitionBy(agent, run).orderBy("seq", "_old", key)
    return m.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).drop("_old")


def split_run(rows: DataFrame, keys: list[str], label: str, after: int) -> DataFrame:
    """part 1 for events numbered beyond `after`, numbered anew, with the first one's label as goal."""
    moved = F.col("seq") > after
    w = Window.partitionBy(*keys, "part").orderBy("seq")
    r = rows.withColumn("part", moved.cast("int"))
    goal = F.when(moved, F.first(label).over(w))
    return r.withColumn("goal", goal).withColumn("seq", F.when(F.col("part") == 1, F.col("seq") - after - 1).otherwise(F.col("seq")))


def newest(rows: DataFrame, keys: list[str], time: str, key: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(key)))).where(F.col("_n") <= n).drop("_n")
