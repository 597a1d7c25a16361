"""Request and response scans over documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.functions import text as T
from turnlake.operators import redaction
from turnlake.plans.leaks import FRAGMENTS
from turnlake.registry import query
from turnlake.sources.tables import read

PATTERN = "|".join(T.PRESETS)
BLOCK = "This output holds protected content."
#: Every fifth document holds a secret.
TEXT = "text || case when doc_id % 5 = 0 then ' sk-' || repeat('a1', 12) else '' end"


@query("ca9_request_scan", FRAGMENTS + f""", f as (select doc_id, {TEXT} text from documents), hit as (select distinct doc_id from x join w using (f))
select doc_id, case when c then 'content' else 'file' end way, case when c then length(regexp_replace(text, '{PATTERN}', '[secret]', 'g')) when doc_id % 3 = 1 then {len(BLOCK)} else length(text) end chars
from (select *, regexp_matches(text, '{PATTERN}') c from f) where c or (doc_id % 3 < 2 and doc_id in (select doc_id from hit))""")
def ca9(spark, sf_dir):
    """Documents as fields: users', tools' results, and assistants', which aren't compared with files. Masks keep lengths."""
    fields = read(spark, sf_dir, "documents").select("doc_id", F.expr(TEXT).alias("text"), (F.col("doc_id") % 3 < 2).alias("model_input"), (F.col("doc_id") % 3 == 1).alias("tool_result"))
    got = redaction.scan_request(fields, "doc_id", PATTERN, read(spark, sf_dir, "benchmark"), "item_id", BLOCK)
    return got.select("doc_id", "way", F.length("text").cast("long").alias("chars"))


@query("ca10_response_scan", "select event_id, case when event_id % 2 = 0 then 'run s-' || user_id || '-1 and [[00000009]] s-' || user_id || '-1' else 'run [[00000001]] [secret]' end text from events")
def ca10(spark, sf_dir):
    """Even events are tool fields, whose sessions (users) know token 1; odd ones are texts."""
    text = F.when(F.col("event_id") % 2 == 0, "run [[00000001]] and [[00000009]] [[00000001]]").otherwise("run [[00000001]] sk-" + "a1" * 12)
    fields = read(spark, sf_dir, "events").select("event_id", "user_id", text.alias("text"), (F.col("event_id") % 2 == 0).alias("tool_related"))
    vault = read(spark, sf_dir, "events").select(F.col("user_id").alias("session")).distinct().select("session", F.lit("[[00000001]]").alias("token"), F.concat(F.lit("s-"), F.col("session").cast("string"), F.lit("-1")).alias("secret"))
    return redaction.scan_response(fields, "event_id", "user_id", vault, PATTERN)
