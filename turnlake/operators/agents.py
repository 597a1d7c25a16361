"""Run statistics, risk and finalisation per agent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_stats(runs: DataFrame, agent: str = "user_id") -> DataFrame:
    """Counts by status (any other than completed and failed counts as running), turns, and a thousand times their mean."""
    got = runs.groupBy(agent).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("turns").alias("turns"))
    return got.select(agent, "total", "completed", "failed", (F.col("total") - F.col("completed") - F.col("failed")).alias("running"), "turns", F.floor(F.col("turns") * 1000 / F.col("total")).cast("long").alias("avg_turns_milli"))


def run_risk(run_audits: DataFrame, audits: DataFrame) -> DataFrame:
    """Sums over each run's distinct audits; high_risk if any counter is above 0. Shuffled by audit_id, which isn't skewed."""
    keys = [c for c in run_audits.columns if c != "audit_id"]
    own = run_audits.dropDuplicates().join(audits, "audit_id", "left")
    got = own.groupBy(*keys).agg(F.coalesce(F.sum("replacements"), F.lit(0)).alias("replacements"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"))
    return got.withColumn("high_risk", (F.col("replacements") > 0) | (F.col("blocks") > 0))


def finalise(runs: DataFrame, as_of: int, idle_minutes: int = 10, least_turns: int = 2) -> DataFrame:
    """Running runs that are idle for `idle_minutes` whole minutes at `as_of` (micros) are completed at their last activity."""
    over = (F.col("status") == "running") & (F.col("turns") >= least_turns) & (F.floor((F.lit(as_of) - F.col("ended")) / 60_000_000) >= idle_minutes)
    return runs.withColumn("ended_at", F.when(over, F.col("ended"))).withColumn("status", F.when(over, "completed").otherwise(F.col("status")))
