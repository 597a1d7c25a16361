"""Request and response bodies: JSON, server-sent events, usage. Bodies are built from conversations and events."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from turnlake.functions import bodies as B
from turnlake.registry import query
from turnlake.sources.tables import read, turns


def requests(spark, sf_dir):
    """conv_id, body: one request of a whole conversation, system message first."""
    m = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    msgs = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return m.select("conv_id", F.to_json(F.struct(F.concat(F.lit("m-"), (F.col("conv_id") % 3).cast("string")).alias("model"), msgs.alias("messages"), (F.col("conv_id") % 2 == 0).alias("stream"), F.array(F.struct(F.struct(F.lit("Read").alias("name")).alias("function"))).alias("tools"))).alias("body"))


@query("pf1_pf2_pf20_requests", """with f as (select conv_id, turn, text, role, row_number() over (partition by conv_id, role order by turn) n from conversations)
select conv_id, 'm-' || conv_id % 3 model, count(*) messages, left(max(case when role = 'system' and n = 1 then text end), 500) system, conv_id % 2 = 0 stream, true has_tools, 'Read' tools from f group by conv_id""")
def pf1(spark, sf_dir):
    return B.parse_requests(requests(spark, sf_dir), "body").select("conv_id", "model", F.size("messages").cast("long").alias("messages"), "system", "stream", F.col("has_tools"), F.array_join("tools", ",").alias("tools"))


@query("pf3_message_delta", "with c as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) pos from conversations) select conv_id, pos - 1 pos, role, md5(text) m from c where pos > conv_id % 4")
def pf3(spark, sf_dir):
    """Clients resend the history: the first messages that were seen (here conv_id mod 4) are dropped."""
    r = B.parse_requests(requests(spark, sf_dir), "body").withColumn("seen", (F.col("conv_id") % 4).cast("int"))
    return B.delta(r, "seen").select("conv_id", "pos", "role", F.md5("content").alias("m"))


USAGE = """case event_id % 4 when 0 then '{"usage":{"prompt_tokens":' || event_id || ',"completion_tokens":5}}' when 1 then '{"message":{"usage":{"input_tokens":3,"output_tokens":' || event_id || '}}}'
  when 2 then '{"usageMetadata":{"promptTokenCount":7,"candidatesTokenCount":2,"totalTokenCount":' || event_id || '}}' else '{"id":1}' end"""


@query("fn14_usage", "select event_id, case event_id % 4 when 0 then event_id when 1 then 3 when 2 then 7 end prompt, case event_id % 4 when 0 then 5 when 1 then event_id when 2 then 2 end completion, case event_id % 4 when 0 then event_id + 5 when 1 then event_id + 3 when 2 then case when event_id > 0 then event_id else 9 end end total from events")
def fn14(spark, sf_dir):
    u = B.usage(F.expr(USAGE.replace("|| event_id ||", "|| cast(event_id as string) ||")))
    return read(spark, sf_dir, "events").select("event_id", u["prompt"].alias("prompt"), u["completion"].alias("completion"), u["total"].alias("total"))


def streams(spark, sf_dir):
    """conv_id, body: a turn's text as server-sent deltas of 40 characters."""
    t = turns(spark, sf_dir).where("role = 'assistant'").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n = 1")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 40).cast("int")), lambda k: F.substring(F.col("text"), k * 40 + 1, F.lit(40)))
    lines = F.transform(parts, lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices")))))
    return t.where("length(text) > 0").select("conv_id", F.concat(F.array_join(lines, "\n\n"), F.lit("\n\ndata: [DONE]\n")).alias("body"))


FIRST_SAID = "with t as (select conv_id, text, row_number() over (partition by conv_id order by turn) n from conversations where role = 'assistant') select {} from t where n = 1 and length(text) > 0"


@query("fn15_pf4_sse_assembly", FIRST_SAID.format("conv_id, text"))
def fn15(spark, sf_dir):
    return streams(spark, sf_dir).select("conv_id", B.sse_text(F.col("body")).alias("text"))


@query("pf10_body_kinds", FIRST_SAID.format("conv_id, case conv_id % 3 when 0 then 'sse' when 1 then 'json' else 'raw' end kind, case when conv_id % 3 = 0 then cast(ceil(length(text) / 40.0) as bigint) else 0 end events"))
def pf10(spark, sf_dir):
    s = streams(spark, sf_dir).select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.col("body")).when(F.col("conv_id") % 3 == 1, F.lit('{"a":1}')).otherwise("plain words").alias("b"))
    return s.select("conv_id", B.body_kind(F.col("b")).alias("kind"), F.size(B.sse_payloads(F.col("b"))).cast("long").alias("events"))


@query("pf21_first_token", FIRST_SAID.format("conv_id, case when conv_id % 6 = 5 then null else conv_id % 5 + 1 end first_chunk"))
def pf21(spark, sf_dir):
    """The number of the first chunk with a token, in streams of every kind: after as many chunks without one as the id says."""
    def line(*chunks: str) -> Column:
        return F.lit("".join(f"data: {c}\n\n" for c in chunks))

    idle = ['{"choices":[{"delta":{"role":"assistant","content":""}}]}', '{"choices":[{"delta":{"tool_calls":[{"function":{"arguments":"x"}}]}}]}', '{"type":"message_start","delta":{}}', "no json"]
    n, kind = (F.col("conv_id") % 5).cast("int"), F.col("conv_id") % 6
    lead = F.when(n == 0, "")
    for k in range(1, 5):
        lead = lead.when(n == k, line(*idle[:k]))
    quoted = F.to_json(F.struct(F.substring("text", 1, 5).alias("content")))
    reasoned = F.to_json(F.struct(F.substring("text", 1, 5).alias("reasoning_content")))
    token = (
        F.when(kind == 0, F.concat(F.lit('data: {"choices":[{"delta":'), quoted, F.lit("}]}"))).when(kind == 1, F.concat(F.lit('data: {"choices":[{"delta":{}},{"delta":'), reasoned, F.lit("}]}")))
        .when(kind == 2, F.lit('data: {"type":"content_block_delta"}')).when(kind == 3, F.lit('data: {"delta":{"text":"t"}}')).when(kind == 4, F.concat(F.lit('data:{"choices":[{"delta":'), quoted, F.lit("}]}"))).otherwise("")
    )
    t = turns(spark, sf_dir).where("role = 'assistant'").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n = 1 and length(text) > 0")
    chunks = B.sse_payloads(F.concat(lead, token, F.lit("\n\ndata: [DONE]\n")))
    found = F.array_position(F.transform(chunks, B.has_token), F.lit(True))
    return t.select("conv_id", F.when(found > 0, found).alias("first_chunk"))


@query("fn34_reasoning_folding", "select event_id, case event_id % 3 when 0 then 'said thought' when 1 then 'said' end content, event_id % 3 <> 2 kept from events")
def fn34(spark, sf_dir):
    r = F.expr("case when event_id % 3 = 0 then ' thought' end")
    c = F.expr("case when event_id % 3 < 2 then 'said' end")
    folded = B.fold_reasoning(c, r, F.lit(False))
    return read(spark, sf_dir, "events").select("event_id", folded.alias("content"), folded.isNotNull().alias("kept"))


@query("fn35_completion_to_sse", """select conv_id, turn, array_to_string(list_transform(range(0, cast(greatest(0, floor((length(text) - 1) / 256)) as bigint) + 1),
  lambda k: 'data: {"choices":[{"delta":{"content":' || to_json(substring(text, k * 256 + 1, 256)) || '},"index":0}]}'), chr(10) || chr(10)) || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) lines from conversations""")
def fn35(spark, sf_dir):
    """Whole texts as stream lines; reading them again gives the text (tested)."""
    return turns(spark, sf_dir).select("conv_id", "turn", B.to_sse(F.col("text")).alias("lines"))


@query("fn32_protocol_conversion", """select conv_id, '{"model":"m-' || conv_id % 3 || '"' || coalesce(',"system":' || to_json(nullif(string_agg(text, chr(10) order by turn) filter (role = 'system'), '')), '')
  || ',"messages":[' || coalesce(string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' order by turn) filter (role <> 'system'), '') || '],"max_tokens":4096,"stream":' || (conv_id % 2 = 0) || '}' body from conversations group by conv_id""")
def fn32(spark, sf_dir):
    """Requests to the other protocol's shape: the system message moves out of the messages."""
    return requests(spark, sf_dir).select("conv_id", B.to_anthropic(F.col("body")).alias("body"))
