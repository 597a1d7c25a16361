"""Tool-call streams, session ids and the common request."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.functions import gate, identity
from turnlake.plans.bodies import requests
from turnlake.registry import query
from turnlake.sources.tables import read


def _call(index: str, cid: str, name: str, arguments: str) -> str:
    return f"""'data: {{"model":"m","choices":[{{"delta":{{"tool_calls":[{{"index":{index},"id":"{cid}","function":{{"name":"{name}","arguments":"{arguments}"}}}}]}}}}]}}\n'"""


#: Streams by event_id mod 4: 0 and 1 send fragments in order, 2 the tail first, 3 none. Those of 1 remove files.
FRAGMENTS = [[r'{\"cmd\":\"ls ', r"' || event_id || '", r'\"}'], [r'{\"cmd\":\"rm -rf ', r"' || event_id || '", r'\"}'], [r'\"}', r"' || event_id || '", r'{\"cmd\":\"ls '], []]
TEXT_LINE = """'data: {"model":"m","choices":[{"delta":{"content":"hi"}}]}\n'"""
STREAM = "case event_id % 4 " + " ".join(f"when {k} then " + " || ".join([TEXT_LINE, *[_call("0", "c7" if n == 0 else "", "exec" if n == 0 else "", p) for n, p in enumerate(parts)], "'data: [DONE]\n'"]) for k, parts in enumerate(FRAGMENTS)) + " end"
ARGUMENTS = """'{"cmd":"' || case when event_id % 4 = 1 then 'rm -rf ' else 'ls ' end || event_id || '"}'"""


def streams(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.expr("concat_ws('', " + STREAM.replace("\\", "\\\\").replace("\n", "\\n") + ")").alias("body"))


@query("fn16_tool_call_assembly", f"select event_id, 'c7' id, 'exec' name, {ARGUMENTS} arguments from events where event_id % 4 < 3")
def fn16(spark, sf_dir):
    c = streams(spark, sf_dir).select("event_id", F.explode(gate.tool_calls(F.col("body"))).alias("c"))
    return c.select("event_id", "c.id", "c.name", "c.arguments")


def _judge(arguments: str) -> str | None:
    return '{"cmd":"echo refused"}' if "rm -rf" in arguments else None


@query("st7_fn44_tool_call_gate", "select event_id, case event_id % 4 when 1 then 1 else 0 end blocked, cast(case event_id % 4 when 1 then 6 when 3 then 2 else 5 end as integer) lines, case when event_id % 4 = 1 then '{\"cmd\":\"echo refused\"}' when event_id % 4 < 3 then " + ARGUMENTS + " end arguments from events")
def st7(spark, sf_dir):
    """Allowed calls go out as they came (tail-first ones turned round); a refused one becomes notice, call, finish."""
    g = streams(spark, sf_dir).select("event_id", gate.gated(F.col("body"), _judge, "refused").alias("g"))
    return g.select("event_id", "g.blocked", (F.size(F.split("g.body", "\n")) - 1).alias("lines"), F.get(gate.tool_calls(F.col("g.body")), F.lit(0))["arguments"].alias("arguments"))


KEY = "sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('tools:read' || chr(10) || coalesce('user:' || u || chr(10), '') || 'model:m-' || conv_id % 3))"


@query("fn30_session_ids", f"""with u as (select conv_id, min_by(text, turn) filter (where role = 'user' and trim(text) <> '') u from conversations group by 1), h as (select conv_id, {KEY} h from u)
select conv_id, case when conv_id % 7 = 0 then 'own-' || conv_id else substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) end session from h""")
def fn30(spark, sf_dir):
    header = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit(" own-"), F.col("conv_id").cast("string")))
    return requests(spark, sf_dir).select("conv_id", identity.session_id(header, F.col("body")).alias("session"))


@query("fn33_unified_requests", "select conv_id, 'm-' || conv_id % 3 model, count(*) messages, conv_id % 2 = 0 stream, cast(conv_id % 5 as bigint) max_tokens, 0.5::double temperature, case when conv_id % 2 = 1 then 's' end system from conversations group by conv_id")
def fn33(spark, sf_dir):
    """Odd conversations come in the protocol whose system text is a field of its own; the other leaves it among the messages."""
    extra = F.concat(F.lit(',"max_tokens":'), (F.col("conv_id") % 5).cast("string"), F.lit(',"temperature":0.5,"system":"s"}'))
    r = requests(spark, sf_dir).select("conv_id", F.concat(F.regexp_replace("body", r"\}$", ""), extra).alias("body"), F.when(F.col("conv_id") % 2 == 1, "anthropic").otherwise("openai").alias("protocol"))
    u = r.select("conv_id", identity.unified(F.col("body"), F.col("protocol")).alias("u"))
    return u.select("conv_id", "u.model", F.size(F.from_json("u.messages", "array<string>")).cast("long").alias("messages"), "u.stream", "u.max_tokens", "u.temperature", "u.system")
