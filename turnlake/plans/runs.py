"""Runs from events: idle gaps, statistics, overlap with days, windows over ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.operators import agents, sequences
from turnlake.registry import query
from turnlake.sources.tables import RUNS_SQL, events, numbered, read, runs

DAY = 86_400_000_000
DAYS_SQL = f"with {RUNS_SQL}, days as (select *, unnest(range(started // {DAY}, ended // {DAY} + 1)) day_no from runs)"
STEPS_SQL = f"with {RUNS_SQL}, steps as (select user_id, us // {DAY} day_no, event_type, event_id, us, value, row_number() over (partition by user_id, us // {DAY} order by us, event_id) - 1 seq from e)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day in order, seq from 0: an action sequence."""
    ev = events(spark, sf_dir).withColumn("day_no", F.expr(f"us div {DAY}"))
    return ev.withColumn("seq", (F.row_number().over(Window.partitionBy("user_id", "day_no").orderBy("us", "event_id")) - 1).cast("long"))


@query("wn1_idle_gap_sessions", f"with {RUNS_SQL} select user_id, run_no, started, ended, turns, errors, tokens, status from runs")
def wn1(spark, sf_dir):
    return runs(spark, sf_dir).select("user_id", "run_no", "started", "ended", "turns", "errors", "tokens", "status")


@query("ag1_agent_run_stats", f"""with {RUNS_SQL} select user_id, count(*) total, count(*) filter (where status = 'completed') completed, count(*) filter (where status = 'failed') failed,
  count(*) filter (where status not in ('completed', 'failed')) running, cast(sum(turns) as bigint) turns, cast(floor(sum(turns) * 1000 / count(*)) as bigint) avg_turns_milli from runs group by user_id""")
def ag1(spark, sf_dir):
    return agents.run_stats(runs(spark, sf_dir))


@query("ag2_tokens_per_agent_day", f"{DAYS_SQL} select day_no, user_id, cast(sum(tokens) as bigint) tokens, count(*) runs from days group by 1, 2")
def ag2(spark, sf_dir):
    return sequences.by_day(runs(spark, sf_dir)).groupBy("day_no", "user_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("runs"))


@query("ag3_daily_rollup", f"""{DAYS_SQL} select day_no, user_id, count(*) runs, count(*) filter (where status = 'completed') completed, count(*) filter (where status = 'failed') failed,
  cast(sum(turns) as bigint) turns, cast(sum(tokens) as bigint) tokens, count(distinct user_id) agents from days group by rollup (day_no, user_id) having day_no is not null""")
def ag3(spark, sf_dir):
    d = sequences.by_day(runs(spark, sf_dir)).withColumn("agent", F.col("user_id"))
    return d.rollup("day_no", "user_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("turns").alias("turns"), F.sum("tokens").alias("tokens"), F.countDistinct("agent").alias("agents"),
    ).where("day_no is not null")


@query("ag5_jn1_run_risk", f"""with {RUNS_SQL} select user_id, cast(run_no as bigint) run_no, cast(sum(cast(floor(value) as bigint) % 3) as bigint) replacements, count(*) filter (where event_type = 'error') blocks,
  (sum(cast(floor(value) as bigint) % 3) > 0 or count(*) filter (where event_type = 'error') > 0) high_risk from numbered group by 1, 2""")
def ag5(spark, sf_dir):
    """Each run's distinct audits, joined with the audit rows; absent ones count nothing."""
    ev = events(spark, sf_dir)
    audits = ev.select(F.col("event_id").alias("audit_id"), (F.floor("value").cast("long") % 3).alias("replacements"), (F.col("event_type") == "error").cast("long").alias("blocks"))
    return agents.run_risk(numbered(ev).select("user_id", "run_no", F.col("event_id").alias("audit_id")), audits)


@query("ag6_audits_per_run", f"with {RUNS_SQL} select user_id, cast(run_no as bigint) run_no, string_agg(cast(event_id as varchar), ',' order by event_id) audits from numbered group by 1, 2")
def ag6(spark, sf_dir):
    got = numbered(events(spark, sf_dir)).groupBy("user_id", "run_no").agg(F.array_sort(F.collect_set("event_id")).alias("a"))
    return got.select("user_id", "run_no", F.array_join(F.col("a").cast("array<string>"), ",").alias("audits"))


@query("ag7_token_usage", """select user_id, cast(sum(p) as bigint) prompt, cast(sum(c) as bigint) completion, cast(sum(case when t = 0 then p + c else t end) as bigint) total from
  (select user_id, cast(floor(value) as bigint) p, event_id % 7 c, case when event_id % 2 = 0 then 0 else cast(floor(value) as bigint) + 9 end t from events) group by 1""")
def ag7(spark, sf_dir):
    p, c = F.floor("value").cast("long"), F.col("event_id") % 7
    u = events(spark, sf_dir).select("user_id", p.alias("p"), c.alias("c"), F.when(F.col("event_id") % 2 == 0, 0).otherwise(p + 9).alias("t"))
    return u.groupBy("user_id").agg(F.sum("p").alias("prompt"), F.sum("c").alias("completion"), F.sum(F.coalesce(F.nullif("t", F.lit(0)), F.col("p") + F.col("c"))).alias("total"))


GRAMS = f"""{STEPS_SQL}, st as (select user_id, day_no, case when count(*) filter (where event_type = 'error') > 0 then 'failed' else 'completed' end status from steps group by 1, 2),
g as (select user_id, day_no, event_type a, lead(event_type) over w b, lead(event_type, 2) over w c from steps window w as (partition by user_id, day_no order by seq)),
k as (select user_id, day_no, a || ' → ' || b gram, 2 n from g where b is not null union all select user_id, day_no, a || ' → ' || b || ' → ' || c, 3 from g where c is not null)
select gram, n, s success, f failure, case when f = 0 then 'success' when s = 0 then 'failure' else 'mixed' end hint from
(select gram, n, count(*) filter (where status = 'completed') s, count(*) filter (where status = 'failed') f from k join st using (user_id, day_no) group by 1, 2) where s + f >= 2 and (s = 0 or f = 0 or s + f >= 3) order by s + f desc, gram limit 20"""


@query("ag8_ag9_action_patterns", GRAMS)
def ag9(spark, sf_dir):
    s = steps(spark, sf_dir)
    whole = Window.partitionBy("user_id", "day_no")
    s = s.withColumn("status", F.when(F.max((F.col("event_type") == "error").cast("int")).over(whole) > 0, "failed").otherwise("completed"))
    return sequences.patterns(s, ["user_id", "day_no"], "seq", "event_type")


@query("ag13_execution_summary", f"{STEPS_SQL} select user_id, day_no, string_agg(left(event_type, 40), ' → ' order by seq) filter (where seq < 8) summary from steps group by 1, 2")
def ag13(spark, sf_dir):
    return sequences.summary(steps(spark, sf_dir), ["user_id", "day_no"], "seq", "event_type")


@query("wn2_sk5_renumbering", f"{STEPS_SQL} select event_id, seq from steps")
def wn2(spark, sf_dir):
    return steps(spark, sf_dir).select("event_id", "seq")


@query("wn4_parallel_actions", f"{STEPS_SQL} select event_id, coalesce(event_type = 'click' and lag(event_type) over w = 'click' and lag(us // 3600000000) over w = us // 3600000000, false) parallel from steps window w as (partition by user_id, day_no order by seq)")
def wn4(spark, sf_dir):
    """An action right after an action of the same audit (here: the same hour)."""
    s = steps(spark, sf_dir).withColumn("hour", F.expr("us div 3600000000"))
    return sequences.parallel(s, ["user_id", "day_no"], "seq", "event_type", "hour", "click").select("event_id", "parallel")


KINDS = {"signup": "goal", "view": "observation", "click": "action", "purchase": "result", "error": "decision"}
#: The steps as a table that a recursive query reads once a level.
LEVELS_SQL = STEPS_SQL.replace("with ", "with recursive ", 1).replace("steps as (", "steps as materialized (")
KINDS_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items()) + " end"


@query("wn5_ca3_reasoning_graph", f"""{LEVELS_SQL}, t as materialized (select user_id, day_no, seq, {KINDS_SQL} k, us // 3600000000 a from steps),
g as (select user_id, day_no, cast(-1 as bigint) seq, cast(null as bigint) root, cast(null as bigint) chain, cast(null as bigint) dec, cast(null as bigint) act, cast(null as bigint) up, '' k, cast(-1 as bigint) a, cast(null as bigint) parent, '' label from t where seq = 0
  union all select user_id, day_no, seq, case when k in ('goal', 'sub_goal') then seq else root end, case when k = 'action' then chain else seq end, case when k = 'decision' then seq when k in ('action', 'state_transition') then dec end,
    case when k = 'action' then seq when k in ('goal', 'sub_goal', 'decision') then null else act end, case when k = 'action' then parent when k in ('goal', 'sub_goal', 'observation') then null else up end, k, a, parent,
    case when k = 'sub_goal' then 'sub-goal' when k = 'decision' then 'decides' when twin then 'acts' when k = 'action' then case when dec is not null then 'executes' else 'acts' end when k = 'observation' then 'observes'
      when k = 'state_transition' then 'enters' when k = 'result' then 'results in' else 'reflects' end
  from (select *, case when k = 'sub_goal' then root when k = 'goal' then null when k = 'decision' then coalesce(act, dec, chain) when twin then up when k = 'action' then coalesce(dec, chain, act)
      when k in ('observation', 'state_transition') then coalesce(act, chain) else coalesce(chain, act, dec) end parent
    from (select t.*, g.root, g.chain, g.dec, g.act, g.up, t.k = 'action' and g.k = 'action' and g.a = t.a twin from g join t on t.user_id = g.user_id and t.day_no = g.day_no and t.seq = g.seq + 1)))
select user_id, day_no, cast(seq as integer) node, cast(parent as integer) parent, label from g where parent is not null and parent <> seq""")
def wn5(spark, sf_dir):
    """Edges of each user-day's reasoning graph; event types stand for kinds. The SQL goes through the levels of a recursive query."""
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    s = steps(spark, sf_dir).withColumn("kind", kind[F.col("event_type")]).withColumn("audit", F.expr("us div 3600000000"))
    return sequences.graph_edges(s, ["user_id", "day_no"], "seq", "kind", "audit")


@query("wn6_token_batches", f"""{LEVELS_SQL}, t as materialized (select user_id, day_no, seq, cast(floor(value) as bigint) c from steps),
b as (select user_id, day_no, seq, 0 batch, c used from t where seq = 0
  union all select t.user_id, t.day_no, t.seq, case when b.used > 0 and b.used + t.c > 120 then b.batch + 1 else b.batch end, case when b.used > 0 and b.used + t.c > 120 then t.c else b.used + t.c end
  from b join t on t.user_id = b.user_id and t.day_no = b.day_no and t.seq = b.seq + 1) select user_id, day_no, seq, batch from b""")
def wn6(spark, sf_dir):
    """Batches of an agent's event lines by a token limit: a greedy fold, tested against a loop."""
    s = steps(spark, sf_dir).withColumn("cost", F.floor("value").cast("long"))
    return sequences.token_batches(s, ["user_id", "day_no"], "seq", "cost", 120)


@query("wn8_milestones", f"with {RUNS_SQL} select user_id, run_no, (turns // 10 + 1) * 10 next_due from runs")
def wn8(spark, sf_dir):
    return runs(spark, sf_dir).select("user_id", "run_no", ((F.expr("turns div 10") + 1) * 10).alias("next_due"))


@query("wn9_trigger_window", """with r as (select event_id, user_id, event_type, row_number() over w n from events window w as (partition by user_id order by ts, event_id)),
t as (select *, max(case when event_type = 'error' then n end) over (partition by user_id order by n rows unbounded preceding) last from r) select event_id, coalesce(n - last < 15, false) active from t""")
def wn9(spark, sf_dir):
    """A mention (here: an error) arms the session for 15 calls, its own among them."""
    return sequences.armed(events(spark, sf_dir), "user_id", ["us", "event_id"], F.col("event_type") == "error", 15).select("event_id", "active")


@query("st4_idle_finaliser", f"with {RUNS_SQL}, z as (select max(us) now from e) select user_id, run_no, case when status = 'running' and turns >= 2 and floor((now - ended) / 60000000) >= 10 then 'completed' else status end status, case when status = 'running' and turns >= 2 and floor((now - ended) / 60000000) >= 10 then ended end ended_at from runs, z")
def st4(spark, sf_dir):
    as_of = events(spark, sf_dir).agg(F.max("us")).first()[0]
    return agents.finalise(runs(spark, sf_dir), as_of).select("user_id", "run_no", "status", "ended_at")


@query("ol1_newest_runs", f"with {RUNS_SQL} select user_id, run_no, started from runs order by started desc, user_id, run_no limit 100")
def ol1(spark, sf_dir):
    return runs(spark, sf_dir).select("user_id", "run_no", "started").orderBy(F.desc("started"), "user_id", "run_no").limit(100)


@query("ol6_best_run", f"with {RUNS_SQL} select user_id, arg_max(run_no, (turns, started)) run_no, max(turns) turns from runs group by 1")
def ol6(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("user_id").agg(F.max_by("run_no", F.struct("turns", "started")).alias("run_no"), F.max("turns").alias("turns"))


@query("sc12_latest_run", f"with {RUNS_SQL} select user_id, max(run_no) run_no, arg_max(status, run_no) status from runs group by 1")
def sc12(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("user_id").agg(F.max("run_no").alias("run_no"), F.max_by("status", "run_no").alias("status"))


@query("jn2_runs_with_agent_names", f"with {RUNS_SQL} select user_id, run_no, coalesce(c_name, cast(user_id as varchar)) agent from runs left join customer on c_custkey = user_id and c_custkey % 2 = 0")
def jn2(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return runs(spark, sf_dir).join(c, F.col("user_id") == F.col("c_custkey"), "left").select("user_id", "run_no", F.coalesce("c_name", F.col("user_id").cast("string")).alias("agent"))


@query("jn3_agents_on_date", f"{DAYS_SQL} select c_custkey, c_name from customer where c_custkey in (select user_id from days where day_no = (select min(day_no) + 3 from days))")
def jn3(spark, sf_dir):
    d = sequences.by_day(runs(spark, sf_dir))
    third = d.agg(F.min("day_no")).first()[0] + 3
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(d.where(F.col("day_no") == third), F.col("c_custkey") == F.col("user_id"), "left_semi")


@query("ca8_agent_profile", f"""with {RUNS_SQL}, s as (select user_id, count(*) total, count(*) filter (where status = 'completed') completed, cast(sum(turns) as bigint) turns from runs group by 1),
t as (select user_id, string_agg(distinct event_type, ',' order by event_type) tools from e group by 1) select user_id, total, completed, turns, tools from s join t using (user_id)""")
def ca8(spark, sf_dir):
    tools = events(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tools"))
    return agents.run_stats(runs(spark, sf_dir)).select("user_id", "total", "completed", "turns").join(tools, "user_id")


@query("ca6_report_schedule", f"with {RUNS_SQL} select user_id, run_no, case when turns < 2 then 'no' when status <> 'running' then 'final' when turns % 10 = 0 then 'milestone' else 'no' end due from runs")
def ca6(spark, sf_dir):
    return runs(spark, sf_dir).select("user_id", "run_no", F.when(F.col("turns") < 2, "no").when(F.col("status") != "running", "final").when(F.col("turns") % 10 == 0, "milestone").otherwise("no").alias("due"))
