"""Responses converted between protocols, and streams through the line transformer."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from turnlake.functions import lines as L
from turnlake.functions import text as T
from turnlake.registry import query
from turnlake.sources.tables import read
from turnlake.streaming.lines import transform_lines

BLOCKS = """'{"id":"r' || event_id || '","model":"m","content":[{"type":"text","text":"a' || user_id || '"},{"type":"tool_use","id":"c","name":"exec","input":{"n":' || event_id || '}},{"type":"text","text":"b"}]' || case when event_id % 2 = 0 then ',"stop_reason":"tool_use"' else '' end || '}'"""


def _spark(sql: str) -> str:
    return re.sub(r"\|\| (event_id|user_id)\b", r"|| cast(\1 as string)", sql)


@query("fn32_responses_to_chat", "select event_id, 'r' || event_id id, 'a' || user_id || 'b' said, '{\"n\":' || event_id || '}' arguments, case when event_id % 2 = 0 then 'tool_use' else 'stop' end finish from events")
def fn32_chat(spark, sf_dir):
    r = read(spark, sf_dir, "events").select("event_id", L.response_to_chat(F.expr(_spark(BLOCKS))).alias("b"))
    get = lambda path: F.get_json_object("b", path)
    return r.select("event_id", get("$.id").alias("id"), get("$.choices[0].message.content").alias("said"), get("$.choices[0].message.tool_calls[0].function.arguments").alias("arguments"), get("$.choices[0].finish_reason").alias("finish"))


@query("fn32_responses_to_blocks", "select event_id, 'a' || user_id || 'b' said, 'tool_use' kind2, '{\"n\":' || event_id || '}' input, 'end_turn' stop from events")
def fn32_blocks(spark, sf_dir):
    """There and back: the texts are one block now, the input is JSON again."""
    r = read(spark, sf_dir, "events").select("event_id", L.response_to_blocks(L.response_to_chat(F.expr(_spark(BLOCKS)))).alias("b"))
    get = lambda path: F.get_json_object("b", path)
    return r.select("event_id", get("$.content[0].text").alias("said"), get("$.content[1].type").alias("kind2"), get("$.content[1].input").alias("input"), get("$.stop_reason").alias("stop"))


_SECRETS = re.compile("|".join(T.PRESETS))


def _make() -> L.Lines:
    return L.Lines(lambda a: '{"cmd":"echo refused"}' if "rm -rf" in a else None, "refused", "chat", lambda t: _SECRETS.sub("[secret]", t))


#: Five lines a stream: text with a secret, nothing but an empty content, reasoning, a call (refused for odd ids), the end.
SENT = [
    """'data: {"type":"content_block_delta","delta":{"text":"k sk-' || repeat('a1', 12) || ' ' || event_id || '"}}'""",
    """'data: {"choices":[{"delta":{"content":""}}]}'""",
    """'data: {"choices":[{"delta":{"content":"x","reasoning_content":"y"}}]}'""",
    """'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"c","function":{"name":"exec","arguments":"' || case when event_id % 2 = 1 then 'rm -rf ' else 'ls ' end || event_id || '"}}]}}]}'""",
    "'data: [DONE]'",
]
SAID = """'data: {"choices":[{"index":0,"delta":{"content":"k [secret] ' || event_id || '"}}]}'"""


@query("st8_line_transformer", f"""select event_id, pos, count(*) lines, any_value(line) filter (where pos < 4) line from (select event_id, 0 pos, {SAID} line from events union all select event_id, 2, 'data: {{"choices":[{{"delta":{{"content":"xy"}}}}]}}' from events
  union all select event_id, 4, null from events, range(5) r(k) where event_id % 2 = 1 or k < 2) group by 1, 2""")
def st8(spark, sf_dir):
    """Converted, cleaned and redacted line by line; a refused call goes out as five lines (notice in two, call, finish, end)."""
    sent = F.array(*[F.expr(_spark(x)) for x in SENT])
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("stream_id"), F.posexplode(sent).alias("pos", "line"))
    got = transform_lines(rows.withColumn("pos", F.col("pos").cast("long")), _make)
    return got.groupBy(F.col("stream_id").cast("long").alias("event_id"), F.col("pos").cast("int").alias("pos")).agg(F.count(F.lit(1)).alias("lines"), F.min(F.when(F.col("pos") < 4, F.col("line"))).alias("line"))
