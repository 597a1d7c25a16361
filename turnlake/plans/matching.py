"""Hashes, placeholders, path mentions, patterns, filters, counters and replaced reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.functions import matching as M
from turnlake.operators import keeping
from turnlake.plans.reports import EVENTS_SQL, cognitive
from turnlake.plans.runs import STEPS_SQL, steps
from turnlake.registry import query
from turnlake.sources import files
from turnlake.sources.tables import read


@query("fn1_short_hash")
def fn1(spark, sf_dir):
    """DuckDB has no such hash; the test compares with the library's."""
    return read(spark, sf_dir, "documents").select("doc_id", M.short_hash(F.col("text")).alias("hash"))


_NEW = "case doc_id % 5 when 0 then left(text, 40) || '[[0000abcd]]' || substring(text, 60, 90) when 1 then left(text, 40) || substring(text, 60, 90) when 2 then '[[00000001]]' || substring(text, 30, 20) || '[[00000002]]' when 3 then substring(text, 60, 30) || '[[0000abcd]]' || left(text, 40) else left(text, 10) || '[[0000abcd]]q#z' end"


@query("fn26_only_tokens_differ", rf"""with n as (select doc_id, text, {_NEW} t from documents) select doc_id, regexp_matches(t, '\[\[[0-9a-f]{{8}}\]\]') and regexp_matches(text, '(?s)' || regexp_replace(regexp_escape(t), '\\\[\\\[[0-9a-f]{{8}}\\\]\\\]', '.*', 'g')) pure from n""")
def fn26(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", M.only_tokens_differ(F.col("text"), F.expr(_NEW)).alias("pure"))


_PATH = "'/srv/u' || cast(user_id % 10 as {0}) || '/d'"
_SAID = "case event_id % 6 when 0 then 'open /srv/u' || cast(event_id % 20 as {0}) || '/d' when 1 then '/srv/u' || cast(user_id % 10 as {0}) || '/d2' when 2 then 'x/srv/u' || cast(user_id % 10 as {0}) || '/d' when 3 then '(/srv/u' || cast(user_id % 10 as {0}) || '/d)' when 4 then replace('rm /srv/u' || cast(user_id % 10 as {0}) || '/d/e', '/', chr(92)) else event_type end"


@query("fn29_path_mentions", f"""with p as (select event_id, {_PATH.format('varchar')} p, {_SAID.format('varchar')} t from events), n as (select *, '(^|[^A-Za-z0-9_-])' a, '($|[^A-Za-z0-9_-])' z from p)
select event_id, regexp_matches(t, a || regexp_escape(p) || z) or regexp_matches(t, a || regexp_escape(replace(p, '/', chr(92))) || z) hit from n""")
def fn29(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", M.mentions_path(F.expr(_PATH.format("string")), F.expr(_SAID.format("string"))).alias("hit"))


@query("fn39_pattern_in_run", f"""{STEPS_SQL}, a as (select user_id, day_no, list(event_type order by seq) x from steps group by 1, 2), s as (select user_id, day_no, list(left(event_type, 4) order by event_id) p from (select *, row_number() over (partition by user_id, day_no order by event_id) n from steps) where n <= 2 group by 1, 2)
select user_id, day_no, len(x) >= len(p) and len(list_filter(range(1, len(x) - len(p) + 2), lambda i: (contains(x[i], p[1]) or contains(p[1], x[i])) and (len(p) < 2 or contains(x[i + 1], p[2]) or contains(p[2], x[i + 1])))) > 0 hit from a join s using (user_id, day_no)""")
def fn39(spark, sf_dir):
    """Whether the first letters of a user-day's two lowest events, as a pattern, stand in its actions in turn."""
    s = steps(spark, sf_dir)
    acts = s.groupBy("user_id", "day_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event_type"))), lambda x: x["event_type"]).alias("x"), F.slice(F.array_sort(F.collect_list(F.struct("event_id", F.substring("event_type", 1, 4).alias("t")))), 1, 2).alias("p"))
    return acts.select("user_id", "day_no", M.matches_run(F.transform("p", lambda x: x["t"]), F.col("x")).alias("hit"))


BITS = 4096
_H = "event_id * 2654435761"
_POS = f"list_transform(range(0, 7), lambda i: ((({_H}) % {BITS}) + i * (((({_H}) >> 17) | 1) % {BITS})) % {BITS})"


@query("fn40_bloom_filter", f"with e as (select event_id, {_POS} p from events), b as (select distinct unnest(p) bit from e where event_id % 50 = 0), u as (select event_id, unnest(list_distinct(p)) bit from e) select event_id, count(b.bit) = count(*) maybe from u left join b on u.bit = b.bit group by 1")
def fn40(spark, sf_dir):
    """A filter of every fiftieth event, asked for all."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2654435761).alias("h"))
    return M.may_contain(e, "event_id", "h", M.bloom(e.where("event_id % 50 = 0"), "h", BITS), BITS)


@query("fn41_literal_samples", "select distinct item_id, s from (select item_id, unnest([substr(text, 1, 32), substr(text, greatest(1, cast(floor((length(text) - 32) / 2.0) as bigint) + 1), 32), substr(text, greatest(1, length(text) - 31), 32)]) s from benchmark)")
def fn41(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.explode(M.samples(F.col("text"), 32)).alias("s"))


_TOKENS = r"'[A-Za-z]{3,}'"


@query("ol5_so4_token_orders", f"""with t as (select conv_id, turn, list_distinct(regexp_extract_all(text, {_TOKENS})) a, list_distinct(regexp_extract_all(text, '[0-9]+')) b from conversations)
select conv_id, turn, array_to_string(list_transform(list_sort(list_transform(a, lambda x: {{'n': -length(x), 't': x}})), lambda s: s.t), ' ') longest, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') every from t""")
def ol5(spark, sf_dir):
    a, b = F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), F.lit(1)), F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(M.longest_first(a), " ").alias("longest"), F.array_join(M.union_of(a, b), " ").alias("every"))


@query("ol4_limits", "select event_id, least(500, greatest(1, case when event_id % 3 = 0 then 200 else event_id - 40 end)) agents, least(10000, greatest(1, case when event_id % 3 = 0 then 500 else event_id * 7 - 40 end)) traffic from events")
def ol4(spark, sf_dir):
    asked = F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    return read(spark, sf_dir, "events").select("event_id", M.clamp(asked - 40, 1, 500, 200).alias("agents"), M.clamp(asked * 7 - 40, 1, 10_000, 500).alias("traffic"))


@query("ag12_pipeline_counters", "select event_type, count(*) filter (where event_id % 4 < 2) processed, count(*) filter (where event_id % 4 = 2) spilled, count(*) filter (where event_id % 4 = 2 and value > 50) recovered, count(*) filter (where event_id % 4 = 3) dropped from events group by 1")
def ag12(spark, sf_dir):
    """What became of each turn that was offered to a bounded queue: taken, spilled (and read again), or dropped."""
    way = F.col("event_id") % 4
    counts = {"processed": way < 2, "spilled": way == 2, "recovered": (way == 2) & (F.col("value") > 50), "dropped": way == 3}
    return read(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


@query("ud1_safety_findings", f"{EVENTS_SQL} select distinct conv_id, finding from (select conv_id, case when contains(summary, 'rm -rf') then 'removes a tree' when contains(summary, 'curl ') then 'calls out' end finding from q where kind = 'action') where finding is not null")
def ud1(spark, sf_dir):
    """A caller's scanner on the actions of each run."""
    return M.findings(cognitive(spark, sf_dir), "conv_id", lambda t: F.when(t.contains("rm -rf"), "removes a tree").when(t.contains("curl "), "calls out"))


@query("sk6_pf19_reports", "select user_id, count(*) events, user_id % 3 = 0 or user_id % 2 = 0 shown from events group by 1")
def sk6(spark, sf_dir):
    """A report of half the events is replaced by one of all; it is shown if a model made it or model mode is off."""
    path = files.scratch(spark, "reports")
    e = read(spark, sf_dir, "events")
    keeping.put_reports(e.where("event_id % 2 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("events")), "user_id", path)
    keeping.put_reports(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events")), "user_id", path)
    got = keeping.reports(spark, path, "user_id long, events long", "user_id")
    return got.select("user_id", "events", ((F.col("user_id") % 3 == 0) | ~(F.col("user_id") % 2 != 0)).alias("shown"))
