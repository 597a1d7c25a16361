"""Upserts, caps, retention, merges and splits of stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import stores
from turnlake.registry import query
from turnlake.sources.tables import RUNS_SQL, events, numbered, read, runs

DAY = 86_400_000_000


@query("sk1_audit_cap", "select event_id, us from (select event_id % 8000 event_id, max(epoch_us(ts)) us from events group by 1) order by us desc, event_id limit 5000")
def sk1(spark, sf_dir):
    """Insert or replace by id, then the newest 5000 stay."""
    a = events(spark, sf_dir).select((F.col("event_id") % 8000).alias("event_id"), "us")
    return stores.capped(a.groupBy("event_id").agg(F.max("us").alias("us")), "us", "event_id", 5000)


@query("sk3_agent_upsert", "select user_id, arg_max(event_type, (ts, event_id)) display_name, min(epoch_us(ts)) first_seen, max(epoch_us(ts)) last_seen, arg_min(props, (ts, event_id)) tools from events group by 1")
def sk3(spark, sf_dir):
    """Names follow the last write; first_seen and tools keep the first."""
    return stores.upsert(events(spark, sf_dir).withColumnRenamed("event_type", "display_name").withColumnRenamed("props", "tools"), "user_id", ["us", "event_id"], latest=["display_name"], earliest=["tools"], seen="us")


@query("sk7_jn5_unprocessed", "select event_type, case when event_id % 3 = 0 then 'processed' when event_type = 'error' then 'failed' when props is null then 'no body' else 'submitted' end outcome, count(*) n from events group by 1, 2")
def sk7(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    ledger = ev.where("event_id % 3 = 0").select("event_id")
    return stores.replay_outcomes(ev, ledger, "event_id", F.col("event_type") == "error", F.col("props").isNull()).groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("sk8_snapshots", "select page_id, cast(strlen(html) as bigint) bytes, cast(least(strlen(html), 4096) as bigint) saved, strlen(html) > 4096 truncated from pages")
def sk8(spark, sf_dir):
    return stores.snapshots(read(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("body")), 4096).select("page_id", "bytes", "saved", "truncated")


@query("sk9_snapshot_retention", f"with a as (select event_id, epoch_us(ts) us, cast(floor(value) as bigint) size from events), k as (select * from a where us >= (select max(us) from a) - 7 * {DAY}), r as (select *, sum(size) over (order by us desc, event_id desc rows unbounded preceding) total from k) select event_id, cast(total as bigint) total from r where total <= 40000")
def sk9(spark, sf_dir):
    a = events(spark, sf_dir).select("event_id", "us", F.floor("value").cast("long").alias("size"))
    newest = a.agg(F.max("us")).first()[0]
    return stores.within_size(a.where(F.col("us") >= newest - 7 * DAY), "us", "event_id", "size", 40000).select("event_id", "total")


@query("sk10_retention_purge", f"with {RUNS_SQL}, x as (select *, started < (select max(ended) from runs) - 10 * {DAY} old from runs) select count(*) filter (where old) runs, cast(coalesce(sum(turns) filter (where old), 0) as bigint) events, count(*) filter (where not old) kept from x")
def sk10(spark, sf_dir):
    r = runs(spark, sf_dir)
    old = F.col("started") < F.lit(r.agg(F.max("ended")).first()[0] - 10 * DAY)
    return r.agg(F.count_if(old).alias("runs"), F.coalesce(F.sum(F.when(old, F.col("turns"))), F.lit(0)).alias("events"), F.count_if(~old).alias("kept"))


MERGED = f"with {RUNS_SQL}, m as (select event_id, user_id, us, case when run_no in (2, 3) then 1 else run_no end run_no, run_no old from numbered), s as (select *, row_number() over (partition by user_id, old order by us, event_id) - 1 seq from m)"


@query("sk12_merge_runs", f"{MERGED} select event_id, cast(run_no as bigint) run_no, row_number() over (partition by user_id, run_no order by seq, old, event_id) - 1 seq from s")
def sk12(spark, sf_dir):
    """Runs 2 and 3 of every agent go into run 1; events are numbered anew by their old numbers, the target's first."""
    return stores.merge_runs(stores.sequenced(numbered(events(spark, sf_dir)), ["user_id", "run_no"], ["us", "event_id"]), "user_id", "run_no", [2, 3], 1, "event_id").select("event_id", "run_no", "seq")


@query("sk13_split_run", "with s as (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 seq from events) select event_id, case when seq > 20 then 1 else 0 end part, case when seq > 20 then seq - 21 else seq end seq, case when seq > 20 then first_value(event_type) over (partition by user_id, seq > 20 order by seq) end goal from s")
def sk13(spark, sf_dir):
    """Events beyond number 20 move to a new run, whose goal is the first moved one's."""
    s = stores.sequenced(events(spark, sf_dir), ["user_id"], ["us", "event_id"])
    return stores.split_run(s, ["user_id"], "event_type", 20).select("event_id", "part", "seq", "goal")


@query("sc4_newest_per_session", "select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n <= 5")
def sc4(spark, sf_dir):
    return stores.newest(events(spark, sf_dir), ["user_id"], "us", "event_id", 5).select("event_id", "user_id")


@query("sc3_body_pairs", "select user_id, coalesce(arg_min(props, event_id) filter (where event_type = 'view'), arg_min(props, event_id) filter (where event_type = 'click')) request, coalesce(arg_min(props, event_id) filter (where event_type = 'purchase'), arg_min(props, event_id) filter (where event_type = 'signup')) response from events group by 1")
def sc3(spark, sf_dir):
    """The sent request, else the received one; the same for responses. Event types stand for the phases."""
    ev = events(spark, sf_dir)
    first = {t: F.min_by(F.when(F.col("event_type") == t, F.col("props")), F.when(F.col("event_type") == t, F.col("event_id"))) for t in ("view", "click", "purchase", "signup")}
    return ev.groupBy("user_id").agg(F.coalesce(first["view"], first["click"]).alias("request"), F.coalesce(first["purchase"], first["signup"]).alias("response"))


@query("sc11_event_log", "select event_id, event_type from events order by ts desc, event_id desc limit 500")
def sc11(spark, sf_dir):
    return events(spark, sf_dir).orderBy(F.desc("us"), F.desc("event_id")).limit(500).select("event_id", "event_type")
