"""Operation rules, path protection, fallback chains and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.functions import text as T
from turnlake.operators import policies
from turnlake.registry import query
from turnlake.sources.tables import events, read

COMMANDS = ["rm -rf /srv/data/{k}", "curl http://h/{k}", "read_file /srv/data/{k}/x", "echo hi > /srv/keep/{k}", "ls -la", 'fetch("grpc")', "cat /etc/hosts", "mv a b"]
COMMAND = "case event_id % 8 " + " ".join("when {} then '{}'".format(i, c.replace("{k}", "' || cast(user_id as string) || '")) for i, c in enumerate(COMMANDS)) + " end"
RULES = [(0, "no-rm", "command_exec", "rm -rf", False), (1, "no-net", "network_access", r"curl\s+http", True), (2, "no-rpc", "api_call", "grpc", False)]
PROTECTED = [("p1", "/srv/data", "deny_access"), ("p2", "/srv/keep", "deny_modify"), ("p3", "/etc", "deny_delete")]


def commands(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.expr(COMMAND).alias("text"))


def rules(spark):
    return spark.createDataFrame(RULES, "ord int, id string, operation string, pattern string, is_regex boolean")


FIRST = "case event_id % 8 when 0 then 'no-rm' when 1 then 'no-net' when 5 then 'no-rpc' end"


@query("pf14_operation_rules", f"select event_id, {FIRST} rule from events where event_id % 8 in (0, 1, 5)")
def pf14(spark, sf_dir):
    return policies.first_rule(commands(spark, sf_dir), "event_id", rules(spark)).select("event_id", F.col("id").alias("rule"))


@query("pf15_path_protection", "select event_id, case event_id % 8 when 0 then 'p1' when 2 then 'p1' when 3 then 'p2' end rule, case event_id % 8 when 0 then 'delete' when 2 then 'access' else 'modify' end intent from events where event_id % 8 in (0, 2, 3)")
def pf15(spark, sf_dir):
    p = spark.createDataFrame(PROTECTED, "id string, path string, level string")
    return policies.blocked_paths(commands(spark, sf_dir), "event_id", p).select("event_id", F.col("id").alias("rule"), "intent")


@query("pf16_observe_or_enforce", f"""with m as (select user_id, event_id, {FIRST} rule from events) select user_id, count(*) filter (where rule is not null and user_id % 2 = 0) blocks, count(*) filter (where rule is not null and user_id % 2 = 1) observes, string_agg(distinct rule, ',' order by rule) kinds from m group by 1""")
def pf16(spark, sf_dir):
    """Sessions with even ids enforce, others observe."""
    c = commands(spark, sf_dir)
    hit = c.join(policies.first_rule(c, "event_id", rules(spark)).select("event_id", "id"), "event_id", "left")
    return policies.enforce(hit.withColumn("enforce", F.col("user_id") % 2 == 0), "user_id")


ATTEMPTS = "(select l_orderkey request_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) ord, l_partkey model, case l_returnflag when 'N' then 200 when 'R' then 503 else 429 end status from lineitem)"


def attempts(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    status = F.when(F.col("l_returnflag") == "N", 200).when(F.col("l_returnflag") == "R", 503).otherwise(429)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.row_number().over(w).alias("ord"), F.col("l_partkey").alias("model"), status.alias("status"))


@query("pf17_fallback_status", f"select status, count(*) n, status in (401,403,404,408,415,429,500,502,503,504) retry from {ATTEMPTS} group by 1")
def pf17(spark, sf_dir):
    return attempts(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("retry", F.col("status").isin(T.FALLBACK_STATUS))


@query("ca14_fallback_chains", f"""with a as {ATTEMPTS}, f as (select request_id, min(ord) filter (where status = 200) done from a group by 1)
select request_id, string_agg(cast(model as varchar), ' → ' order by ord) chain, max(case when ord = done then model end) final_model, case when max(done) is null then 502 else 200 end status from a join f using (request_id) where done is null or ord <= done group by 1""")
def ca14(spark, sf_dir):
    return policies.fallback_chains(attempts(spark, sf_dir))


@query("pf18_model_groups", "select p_partkey, case p_partkey % 5 when 0 then 'high' when 1 then 'low' when 2 then 'medium' end grp from part")
def pf18(spark, sf_dir):
    model = F.expr("case p_partkey % 5 when 0 then ' HIGH ' when 1 then 'lite' when 2 then 'gw/medium' when 3 then 'other' else '' end")
    return read(spark, sf_dir, "part").select("p_partkey", policies.model_group(model, "gw").alias("grp"))


@query("pf9_protocols", "select p_partkey, case p_partkey % 4 when 0 then 'anthropic' when 1 then 'openai' when 2 then 'anthropic' else 'openai' end protocol from part")
def pf9(spark, sf_dir):
    header = F.expr("case when p_partkey % 4 = 0 then 'anthropic' end")
    body = F.expr("case p_partkey % 4 when 1 then '{\"tools\":[],\"messages\":[]}' when 2 then '{\"system\":\"x\",\"messages\":[]}' else '{}' end")
    path = F.expr("case when p_partkey % 4 = 3 then '/v1/chat/completions' else '/v1/x' end")
    return read(spark, sf_dir, "part").select("p_partkey", policies.protocol(path, header, body).alias("protocol"))


@query("ag14_ca18_session_notices", f"with m as (select user_id, event_id, epoch_us(ts) us, {FIRST} rule from events), r as (select *, row_number() over (partition by user_id order by us, event_id) n from m where rule is not null) select user_id, event_id from r where n = 1")
def ca18(spark, sf_dir):
    """The one event of a session that carries a notice: its first block."""
    ev = events(spark, sf_dir).select("event_id", "us")
    hit = policies.first_rule(commands(spark, sf_dir), "event_id", rules(spark)).join(ev, "event_id")
    return hit.groupBy("user_id").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("event_id"))
