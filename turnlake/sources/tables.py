"""Readers, and adapters from the test tables to turns, runs, audits, attempts and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IDLE_MINUTES = 30


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, us, props: an audit or a turn's event each."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros().alias("us"), "props")


def numbered(ev: DataFrame, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """Events with run_no: a run ends where more than `idle_minutes` whole minutes pass (31:00.000 splits, 30:59.999 doesn't)."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    gap = F.floor((F.col("us") - F.lag("us").over(w)) / 60_000_000)
    fresh = F.when(gap.isNull() | (gap > idle_minutes), 1).otherwise(0)
    return ev.withColumn("fresh", fresh).withColumn("run_no", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run: user_id, run_no, started, ended (micros), turns, errors, tokens, status, goal."""
    ev = numbered(events(spark, sf_dir))
    last = F.max_by("event_type", F.struct("us", "event_id"))
    return ev.groupBy("user_id", "run_no").agg(
        F.min("us").alias("started"), F.max("us").alias("ended"), F.count(F.lit(1)).alias("turns"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.sum(F.floor("value").cast("long")).alias("tokens"),
        F.when(F.count_if(F.col("event_type") == "error") > 0, "failed").when(last == "purchase", "completed").otherwise("running").alias("status"),
        F.min_by("event_type", F.struct("us", "event_id")).alias("goal"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text."""
    return read(spark, sf_dir, "conversations")


#: The same runs for DuckDB: common table expressions e, numbered, runs.
RUNS_SQL = """
e as (select event_id, user_id, event_type, value, epoch_us(ts) us, props from events),
flagged as (select *, case when lag(us) over w is null or floor((us - lag(us) over w) / 60000000) > 30 then 1 else 0 end fresh from e window w as (partition by user_id order by us, event_id)),
numbered as (select * exclude (fresh), sum(fresh) over (partition by user_id order by us, event_id rows unbounded preceding) run_no from flagged),
runs as (select user_id, cast(run_no as bigint) run_no, min(us) started, max(us) ended, count(*) turns, count(*) filter (where event_type = 'error') errors, cast(sum(cast(floor(value) as bigint)) as bigint) tokens,
  case when count(*) filter (where event_type = 'error') > 0 then 'failed' when arg_max(event_type, (us, event_id)) = 'purchase' then 'completed' else 'running' end status,
  arg_min(event_type, (us, event_id)) goal from numbered group by user_id, run_no)
"""
