"""Bodies of requests and responses as columns: from_json with a schema for what is known, JSON paths for what varies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CALL = "struct<id:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<{CALL}>>"
REQUEST = f"model string, system string, messages array<{MESSAGE}>, input array<{MESSAGE}>, tools array<struct<name:string,function:struct<name:string>>>, functions array<struct<name:string>>, stream boolean"


def parse_requests(rows: DataFrame, body: str) -> DataFrame:
    """The columns of `rows`, and model, messages, system (500 characters), tools, stream, has_tools. Invalid JSON gives nulls and no messages.

    Content that isn't text (blocks) stays as its JSON in `content`."""
    r = rows.withColumn("_r", F.from_json(F.col(body), REQUEST, {"mode": "PERMISSIVE"}))
    messages = F.coalesce("_r.messages", "_r.input", F.array().cast(f"array<{MESSAGE}>"))
    first = F.get(F.filter(messages, lambda m: m["role"] == "system"), F.lit(0))
    tools = F.filter(F.transform(F.coalesce("_r.tools", F.array().cast("array<struct<name:string,function:struct<name:string>>>")), lambda t: F.coalesce(t["function"]["name"], t["name"])), lambda t: t.isNotNull())
    has = (F.size(F.coalesce("_r.tools", F.array())) > 0) | (F.size(F.coalesce("_r.functions", F.array())) > 0)
    return r.select(*rows.columns, F.col("_r.model").alias("model"), messages.alias("messages"), F.substring(F.coalesce("_r.system", first["content"]), 1, 500).alias("system"), tools.alias("tools"), F.coalesce("_r.stream", F.lit(False)).alias("stream"), has.alias("has_tools"))


def delta(rows: DataFrame, seen: str) -> DataFrame:
    """One row a message after the first `seen`; pos counts from 0 over the whole history."""
    keys = [c for c in rows.columns if c not in ("messages", "body", "tools")]
    m = rows.select(*keys, F.posexplode("messages").alias("pos", "m")).where(F.col("pos") >= F.col(seen))
    return m.select(*keys, F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


def _number(c: Column, base: str, names: list[str]) -> Column:
    found = [F.get_json_object(c, f"{base}.{n}").try_cast("long") for n in names]
    return F.greatest(F.lit(0).cast("long"), F.coalesce(*found, F.lit(0).cast("long")))


def usage(body: Column) -> Column:
    """prompt, completion, total (their sum where it isn't given); null if no place holds any."""
    def one(base: str, p: list[str], c: list[str], t: list[str]) -> Column:
        prompt, completion, total = _number(body, base, p), _number(body, base, c), _number(body, base, t)
        there = (prompt + completion + total) > 0
        return F.when(there, F.struct(prompt.alias("prompt"), completion.alias("completion"), F.when(total > 0, total).otherwise(prompt + completion).alias("total")))

    common = (["prompt_tokens", "input_tokens"], ["completion_tokens", "output_tokens"], ["total_tokens"])
    other = (["promptTokenCount", "prompt_token_count"], ["candidatesTokenCount", "candidates_token_count", "completionTokenCount"], ["totalTokenCount", "total_token_count"])
    return F.coalesce(one("$.usage", *common), one("$.message.usage", *common), one("$.usageMetadata", *other))


def sse_payloads(body: Column) -> Column:
    """The payloads of `data:` lines in order, without [DONE]."""
    lines = F.transform(F.split(body, "\r?\n"), F.trim)
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, F.lit(6), F.length(x))))
    return F.filter(data, lambda x: (x != "") & (x != "[DONE]"))


def sse_text(body: Column) -> Column:
    """The concatenated text deltas of either protocol's chunks."""
    return F.array_join(F.transform(sse_payloads(body), lambda p: F.coalesce(F.get_json_object(p, "$.choices[0].delta.content"), F.get_json_object(p, "$.delta.text"), F.lit(""))), "")


CHUNK = "type string, delta struct<text:string>, choices array<struct<delta:struct<content:string,reasoning_content:string>>>"


def has_token(chunk: Column) -> Column:
    """Whether a stream chunk holds a first token: content or reasoning of any choice, a block's delta, or a delta's text. Tool calls
    are none; what is no JSON neither."""
    c = F.from_json(chunk, CHUNK)
    said = F.exists(F.coalesce(c["choices"], F.array().cast("array<struct<delta:struct<content:string,reasoning_content:string>>>")), lambda x: F.coalesce(x["delta"]["content"] != "", F.lit(False)) | F.coalesce(x["delta"]["reasoning_content"] != "", F.lit(False)))
    return said | F.coalesce(c["type"] == "content_block_delta", F.lit(False)) | F.coalesce(c["delta"]["text"] != "", F.lit(False))


def body_kind(body: Column) -> Column:
    return F.when(F.try_parse_json(body).isNotNull(), "json").when(body.rlike("(?m)^\\s*data:"), "sse").otherwise("raw")


def fold_reasoning(content: Column, reasoning: Column, has_calls: Column) -> Column:
    """Reasoning goes behind the content unless tool calls exist; a delta with neither is null."""
    both = F.concat(F.coalesce(content, F.lit("")), F.coalesce(reasoning, F.lit("")))
    out = F.when(has_calls, F.coalesce(content, F.lit(""))).otherwise(both)
    return F.when((out != "") | has_calls, out)


def to_sse(text: Column, size: int = 256) -> Column:
    n = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(text, k * size + 1, F.lit(size)))
    chunk = F.transform(parts, lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"), F.lit(0).alias("index"))).alias("choices")))))
    return F.concat(F.array_join(chunk, "\n\n"), F.lit("\n\ndata: [DONE]\n\n"))


def to_anthropic(body: Column) -> Column:
    """System texts become `system`; other messages stay; a length limit is added."""
    r = F.from_json(body, REQUEST)
    messages = F.coalesce(r["messages"], r["input"])
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n")
    rest = F.transform(F.filter(messages, lambda m: m["role"] != "system"), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.to_json(F.struct(r["model"].alias("model"), F.when(system != "", system).alias("system"), rest.alias("messages"), F.lit(4096).alias("max_tokens"), r["stream"].alias("stream")))
