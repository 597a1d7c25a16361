"""Session ids from requests, and one form of request for both protocols; all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name space of object ids, and what marks a client's own first message.
NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"
BOOTSTRAP = ["a new session was started via /new or /reset", "session startup sequence", "bootstrap.md", "[bootstrap pending]"]
#: Tokens that the protocol demanding a limit gets where none is given.
DEFAULT_TOKENS = 4096


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version 5 UUID of a name: SHA-1 of the name space and the name, version and variant set. Null names give null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    joined = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(h.isNotNull(), joined)


def _content(message: Column) -> Column:
    """A message's text: the string, or the texts of its blocks; empty otherwise."""
    kind = F.schema_of_variant(F.try_variant_get(message, "$.content", "variant"))
    blocks = F.coalesce(F.try_variant_get(message, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.filter(F.transform(blocks, lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull())
    return F.when(kind == "STRING", F.try_variant_get(message, "$.content", "string")).when(kind.startswith("ARRAY"), F.array_join(texts, "")).otherwise("")


def session_key(body: Column) -> Column:
    """What stays the same over a session's requests: tool names (or the system text, if the request has no tools field), the first real user text, the model. Null: nothing to go by."""
    v = F.try_parse_json(body)
    messages = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    tools = F.try_variant_get(v, "$.tools", "array<variant>")
    names = F.array_sort(F.array_distinct(F.filter(F.transform(tools, lambda t: F.lower(F.try_variant_get(t, "$.function.name", "string"))), lambda n: n.isNotNull())))
    role = lambda m: F.try_variant_get(m, "$.role", "string")
    first = F.get(messages, F.lit(0))
    anchor = F.when(F.size(tools) > 0, F.concat(F.lit("tools:"), F.array_join(names, ","))).when(tools.isNull() & (role(first) == "system"), F.concat(F.lit("system:"), _content(first)))
    said = F.transform(F.filter(messages, lambda m: role(m) == "user"), _content)
    real = F.filter(said, lambda t: (F.trim(t) != "") & ~reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(x)) for x in BOOTSTRAP]))
    user = F.concat(F.lit("user:"), F.get(real, F.lit(0)))
    model = F.concat(F.lit("model:"), F.try_variant_get(v, "$.model", "string"))
    return F.when((F.size(messages) > 0) & (anchor.isNotNull() | user.isNotNull()), F.concat_ws("\n", anchor, user, model))


def session_id(header: Column, body: Column) -> Column:
    """The client's own id, else the UUID of the session key, else a random one."""
    own = F.trim(header)
    return F.coalesce(F.when(own != "", own), uuid5(session_key(body)), F.uuid())


def unified(body: Column, protocol: Column) -> Column:
    """struct<model, messages (JSON), stream, max_tokens, temperature, system>; only one protocol has `system` as a field."""
    v = F.try_parse_json(body)
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    return F.struct(F.coalesce(get("model", "string"), F.lit("")).alias("model"), F.coalesce(F.get_json_object(body, "$.messages"), F.lit("[]")).alias("messages"), F.coalesce(get("stream", "boolean"), F.lit(False)).alias("stream"), get("max_tokens", "bigint").alias("max_tokens"), get("temperature", "double").alias("temperature"), F.when(protocol == "anthropic", get("system", "string")).alias("system"))


def request_body(request: Column, protocol: Column) -> Column:
    """A unified request as one protocol's JSON; absent fields are left out."""
    limit = F.when(protocol == "anthropic", F.coalesce(request["max_tokens"], F.lit(DEFAULT_TOKENS).cast("long"))).otherwise(request["max_tokens"])
    messages = F.from_json(request["messages"], "array<variant>")
    system = F.when(protocol == "anthropic", request["system"])
    return F.to_json(F.struct(request["model"].alias("model"), messages.alias("messages"), limit.alias("max_tokens"), request["stream"].alias("stream"), request["temperature"].alias("temperature"), system.alias("system")))
