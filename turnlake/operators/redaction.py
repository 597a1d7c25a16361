"""Request and response scans: secrets, protected files, and tokens put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text as T
from turnlake.operators.leakscan import shared_fragments
from turnlake.operators.sequences import merge_ranges

TOKEN = r"\[\[[0-9a-f]{8}\]\]"


def mask_ranges(text: Column, ranges: Column) -> Column:
    """`ranges` (array<struct<s, e>>, sorted, apart, from 0, without e) count normalised characters; each range is masked from its
    first character to its last, with what stands between. One pass over the text, however many ranges."""
    chars = F.split(text, "")
    at = F.filter(F.transform(chars, lambda c, i: F.when(c.rlike(rf"[\p{{IsAlphabetic}}{T.KEPT}]"), i + 1)), lambda i: i.isNotNull())
    part = lambda a, n: F.array_join(F.slice(chars, a, n), "")
    spans = F.transform(ranges, lambda r: F.struct(F.get(at, r["s"].cast("int")).alias("a"), F.get(at, (r["e"] - 1).cast("int")).alias("b")))
    begin = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))
    step = lambda x, r: F.struct((r["b"] + 1).alias("k"), F.concat(x["out"], part(x["k"], r["a"] - x["k"]), T.mask(part(r["a"], r["b"] - r["a"] + 1))).alias("out"))
    return F.aggregate(spans, begin, step, lambda x: F.concat(x["out"], part(x["k"], F.greatest(F.lit(0), F.size(chars) - x["k"] + 1))))


def scan_request(fields: DataFrame, field: str, pattern: str, corpus: DataFrame, item: str, block: str) -> DataFrame:
    """field, way, text: the texts that change. `fields` has field (a unique id), text, model_input, tool_result; null texts stay out.

    way 'content': secrets go, by span, and the files aren't looked at. way 'file': what a protected file holds is masked, and a
    tool's result becomes `block` whole."""
    f = fields.select(F.col(field).alias("doc_id"), "text", "model_input", "tool_result").where("text is not null")
    hit = F.col("text").rlike(pattern)
    content = f.where(hit).select("doc_id", F.lit("content").alias("way"), F.regexp_replace("text", pattern, "[secret]").alias("text"))
    rest = f.where(~hit & F.col("model_input"))
    found = merge_ranges(shared_fragments(rest, "doc_id", corpus, item).select("doc_id", "s", "e"), ["doc_id"])
    # Ranges are apart and at least a fragment long, so a text has few for its length.
    ranges = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ranges"))
    files = rest.join(ranges, "doc_id").select("doc_id", F.lit("file").alias("way"), F.when(F.col("tool_result"), F.lit(block)).otherwise(mask_ranges(F.col("text"), F.col("ranges"))).alias("text"))
    return content.unionByName(files).withColumnRenamed("doc_id", field)


def scan_response(fields: DataFrame, field: str, session: str, vault: DataFrame, pattern: str) -> DataFrame:
    """field, text of every field: in tool-related ones a session's own tokens become its secrets again, in the others secrets go.

    `vault` has session, token, secret. Tokens that the session doesn't know, and null texts, stay."""
    tokens = fields.where("tool_related").select(field, F.col(session), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("token"))
    known = tokens.join(vault.select(F.col("session").alias(session), "token", "secret"), [session, "token"]).groupBy(field).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("token", "secret")))).alias("_known"))
    j = fields.join(known, field, "left")
    # Text between tokens and tokens in turn, so a secret that looks like a token isn't replaced again.
    gaps, own = F.split("text", TOKEN, -1), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    put = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.col("_known")[F.get(own, i)], F.get(own, i), F.lit("")))), "")
    return j.select(field, F.when(~F.col("tool_related"), F.regexp_replace("text", pattern, "[secret]")).when(F.col("_known").isNotNull(), put).otherwise(F.col("text")).alias("text"))
