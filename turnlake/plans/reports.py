"""Events of turns, critic scores and daily reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.functions import text as T
from turnlake.operators import reports, sequences
from turnlake.plans.texts import _DEC, _SAY, _like, AL
from turnlake.registry import query
from turnlake.sources.tables import RUNS_SQL, read, runs, turns

DAY = 86_400_000_000
_DONE = f"({_like(AL.format('t'), T.DONE)} or {_like('t', T.DONE_EXACT)} or ({_like(AL.format('t'), T.CONCLUSION)} and length(t) >= case when contains(t, '结论') or contains({AL.format('t')}, 'conclusion') then 40 else 80 end))"
#: Calls and results vary with the conversation, so that all ladders of the critic are met.
_NAME = "case (conv_id * 7 + turn) % 11 when 0 then 'exec' when 1 then 'Edit' when 2 then 'Read' when 3 then 'run_tests' when 4 then 'web_fetch' when 5 then 'bash' when 6 then 'apply_patch' end"
_CALLS = f"case when role = 'assistant' and conv_id % 3 > 0 then {_NAME} end"
_ARGS = "case (conv_id + turn) % 5 when 0 then 'curl ' || left(text, 30) when 1 then 'rm -rf /tmp/x' when 2 then '' when 3 then 'make ' || cast(conv_id as {}) else left(text, 300) end"
_SEEN = "case when role = 'user' and (conv_id + turn) % 4 = 1 then right(text, 700) end"
_LOWN, _BOTH = AL.format("n"), AL.format("n || ' ' || a")
_TOOL = f"case when {_LOWN} in ('exec', 'bash', 'shell', 'run_terminal_cmd') then case when {_like(_BOTH, T.WEB_WORDS)} then 'WebSearch' else 'Exec' end when {_like(_LOWN, ['search', 'web', 'browse'])} then 'WebSearch' else n end"
_LOWT = AL.format("tool")
_STATE = f"case when {_like(_LOWT, ['search', 'web', 'browse', 'read', 'grep', 'list'])} then 'Information gathering' when {_like(_LOWT, ['edit', 'write', 'patch'])} then 'Implementation' when contains({_LOWT}, 'test') or {_LOWT} = 'exec' then 'Verification' end"
EVENTS_SQL = f"""with s as (select conv_id, turn, role, {_SAY} t, {_CALLS} n, {_ARGS.format('varchar')} a, {_SEEN} seen from conversations), m as (select *, {', '.join(f"trim(regexp_extract(t, '{d}', 0)) m{k}" for k, d in enumerate(_DEC))}, {_DONE} done, {_TOOL} tool from s),
d as (select *, case when strlen(m0) > 8 then m0 when strlen(m1) > 8 then m1 when strlen(m2) > 8 then m2 end dec, sum(case when role = 'user' and trim(t) <> '' then 1 else 0 end) over (partition by conv_id order by turn) nth, {_STATE} st from m),
ev as (select conv_id, turn, 0 sub, case when nth = 1 then 'goal' else 'sub_goal' end kind, case when length(trim(t)) > 240 then left(trim(t), 240) || '…' else trim(t) end summary from d where role = 'user' and trim(t) <> ''
 union all select conv_id, turn, 1, 'observation', case when length(seen) > 600 then left(seen, 600) || '…' else seen end from d where seen is not null
 union all select conv_id, turn, 2, 'decision', case when length(dec) > 320 then left(dec, 320) || '…' else dec end from d where role = 'assistant' and dec is not null and trim(t) <> ''
 union all select conv_id, turn, 3, case when done then 'result' else 'reflection' end, case when length(t) > case when done then 600 else 500 end then left(t, case when done then 600 else 500 end) || '…' else t end from d where role = 'assistant' and trim(t) <> '' and (done or n is null)
 union all select conv_id, turn, 4, 'action', tool || case when a = '' then '' else '(' || case when length(a) > 240 then left(a, 240) || '…' else a end || ')' end from d where n is not null
 union all select conv_id, turn, 5, 'state_transition', st from d where n is not null and st is not null),
q as (select *, row_number() over (partition by conv_id order by turn, sub) - 1 seq from ev)"""


def cognitive(spark, sf_dir):
    call = F.struct(F.col("n").alias("name"), F.expr(_ARGS.format("string")).alias("arguments"))
    t = turns(spark, sf_dir).where("role in ('user', 'assistant')").withColumn("n", F.expr(_CALLS)).withColumn("seen", F.expr(_SEEN))
    t = t.select("conv_id", "turn", "role", F.expr(_SAY.replace("I''ll", "I\\'ll")).alias("text"), F.when(F.col("n").isNotNull(), F.array(call)).alias("tool_calls"), F.when(F.col("seen").isNotNull(), F.array("seen")).alias("tool_results"))
    return reports.turn_events(t, "conv_id", "turn")


@query("ca1_wn3_turn_events", f"{EVENTS_SQL} select conv_id, turn, seq, kind, md5(summary) summary from q")
def ca1(spark, sf_dir):
    return cognitive(spark, sf_dir).select("conv_id", "turn", "seq", "kind", F.md5("summary").alias("summary"))


CRITIC_SQL = f"""{EVENTS_SQL}, c as (select conv_id, count(distinct turn) turns, bool_or(kind in ('goal', 'sub_goal')) goal, bool_or(kind = 'result') result, bool_or(kind = 'observation') seen, count(*) filter (where kind = 'action') actions,
 count(distinct summary) filter (where kind = 'action') kinds, coalesce(bool_or(kind = 'action' and (contains(summary, 'Edit') or contains(summary, 'Write(') or contains(summary, 'patch'))), false) edits,
 coalesce(bool_or(kind = 'action' and (contains(summary, 'rm -rf') or (contains(summary, 'delete') and contains(summary, 'all')))), false) risky, coalesce(bool_or(kind = 'state_transition' and summary = 'Verification'), false) verified from q group by 1),
k as (select *, case when edits then 'coding' when actions > 0 then 'explore' else 'chat' end task from c),
z as (select *, case when goal then 85 else 55 end alignment, case task when 'explore' then case when result then 90 when seen and actions > 0 then 75 when actions = 0 then 40 else 60 end when 'coding' then case when verified then 85 when actions = 0 then 40 else 65 end
 else case when result then 85 when turns <= 2 then 70 else 60 end end completeness, case when actions > 2 * kinds then 50 else 80 end necessity, case when turns <= 5 then 90 when turns <= 15 then 75 when turns <= 30 then 60 else 45 end efficiency, case when risky then 40 else 90 end safety from k)"""


@query("ag10_ca4_critic", f"""{CRITIC_SQL} select conv_id, task, alignment, completeness, necessity, efficiency, safety, case when result then 'success' when turns = 0 then 'unknown' when completeness >= 70 then 'partial' else 'unknown' end outcome from z""")
def ag10(spark, sf_dir):
    return reports.critic(cognitive(spark, sf_dir).withColumn("finding", F.lit(False)), "conv_id", "turn").select("conv_id", "task", "alignment", "completeness", "necessity", "efficiency", "safety", "outcome")


DAILY = f"""with {RUNS_SQL}, d as (select *, unnest(range(started // {DAY}, ended // {DAY} + 1)) day_no from runs), f as (select day_no, string_agg(user_id || ':' || run_no || ':' || turns || ':' || status || ':' || tokens, '|' order by user_id || ':' || run_no || ':' || turns || ':' || status || ':' || tokens) fp,
 count(distinct user_id) agents, count(*) runs, count(*) filter (where status = 'completed') completed, count(*) filter (where status = 'failed') failed, count(*) filter (where status = 'running') running, cast(sum(turns) as bigint) turns, cast(sum(tokens) as bigint) tokens from d group by 1)"""


@query("ca7_daily_report", f"{DAILY} select day_no, agents, runs, completed, failed, running, turns, tokens, md5(fp) fingerprint from f")
def ca7(spark, sf_dir):
    return reports.daily(sequences.by_day(runs(spark, sf_dir)))


@query("sk14_daily_markdown", f"{DAILY} select day_no, '# Agents, day ' || day_no || chr(10) || '## Overview' || chr(10) || '- Active agents: ' || agents || chr(10) || '- Completed: ' || completed || ' / In progress: ' || running || ' / Failed: ' || failed || chr(10) || '- Turns: ' || turns || chr(10) || '- Tokens: ' || tokens body from f")
def sk14(spark, sf_dir):
    return reports.markdown(reports.daily(sequences.by_day(runs(spark, sf_dir)))).select("day_no", "body")


def _tile(name: str) -> str:
    return f"'<div class=tile><b>' || {name} || '</b> {name}</div>'"


def _bar(name: str) -> str:
    return f"'<i class={name} style=''width:' || ({name} * 100 // greatest(1, runs)) || '%''></i>'"


@query("sk15_daily_html", f"{DAILY} select day_no, '<section>' || {' || '.join(map(_tile, ('agents', 'runs', 'turns', 'tokens')))} || '<div class=bar>' || {' || '.join(map(_bar, ('completed', 'running', 'failed')))} || '</div></section>' body from f")
def sk15(spark, sf_dir):
    """Escaped HTML with tiles and a bar of statuses; one row a day."""
    return reports.html(reports.daily(sequences.by_day(runs(spark, sf_dir))))


@query("ag4_daily_top_issues", f"""{DAILY.replace(', f as', ', unused as')}, x as (select day_no, case when errors > 0 then 'errors' when turns > 1 then 'long' else 'short' end issue, min(turns * 100000 + user_id) first from d group by 1, 2), r as (select *, row_number() over (partition by day_no order by first, issue) n from x) select day_no, issue, n from r where n <= 6""")
def ag4(spark, sf_dir):
    d = sequences.by_day(runs(spark, sf_dir)).withColumn("issue", F.when(F.col("errors") > 0, "errors").when(F.col("turns") > 1, "long").otherwise("short"))
    return reports.top_distinct(d.withColumn("at", F.col("turns") * 100000 + F.col("user_id")), "day_no", "issue", "at", 6).select("day_no", "issue", F.col("n").cast("long").alias("n"))


@query("fn42_override_merge", "select l_orderkey, l_linenumber, case when l_partkey % 5 > 0 then l_partkey % 5 else l_suppkey % 100 end score from lineitem")
def fn42(spark, sf_dir):
    """A later score wins only above 0."""
    new, old = F.col("l_partkey") % 5, F.col("l_suppkey") % 100
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(new > 0, new).otherwise(old).alias("score"))
