"""Rule matching, path protection, enforcement counters, fallback chains, routing. Rules are policy files: few rows, broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text as T


def operation_class(text: Column, operation: Column) -> Column:
    low = F.lower(text)
    web = (text.contains("http://") | text.contains("https://")) & ~low.contains("curl ") & ~low.contains("wget ")
    return F.when(operation == "command_exec", T.any_of(low, T.COMMAND_WORDS)).when(operation == "api_call", T.any_of(low, T.API_WORDS) | web).when(operation == "network_access", T.any_of(low, T.NETWORK_WORDS)).otherwise(False)


def first_rule(texts: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """The first rule in order that matches each text, by literal or expression and by class; texts without one are left out."""
    r = F.broadcast(rules)
    hit = F.when(F.col("is_regex"), F.expr("text rlike pattern")).otherwise(F.lower("text").contains(F.lower("pattern")))
    j = texts.join(r, hit & operation_class(F.col("text"), F.col("operation")))
    return j.groupBy(*[c for c in texts.columns if c != "text"]).agg(F.min_by("id", "ord").alias("id"), F.min_by("operation", "ord").alias("operation"))


def blocked_paths(texts: DataFrame, key: str, protected: DataFrame) -> DataFrame:
    """The first protected rule (by id) that a text's absolute paths fall under and whose level its intent breaks.

    A path's own ancestors are listed and joined by equality, so rules aren't tried one by one."""
    t = texts.withColumn("intent", T.intent(F.col("text")))
    t = t.withColumn("path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?:^|[\s\"'=])(/[^\s\"';|&]+)"), 1), T.clean_path))))
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    j = t.withColumn("at", F.explode(up)).join(F.broadcast(protected.withColumnRenamed("path", "at")), "at")
    i = F.col("intent")
    broken = F.when(F.col("level") == "deny_delete", i == "delete").when(F.col("level") == "deny_modify", i.isin("delete", "modify")).otherwise(F.lit(True))
    return j.where(broken).groupBy(key).agg(F.min("id").alias("id"), F.min("intent").alias("intent"))


def enforce(hits: DataFrame, session: str) -> DataFrame:
    hit = F.col("id").isNotNull()
    return hits.groupBy(session).agg(F.count_if(hit & F.col("enforce")).alias("blocks"), F.count_if(hit & ~F.col("enforce")).alias("observes"), F.array_sort(F.collect_set("id")).alias("k")).select(
        session, "blocks", "observes", F.when(F.size("k") > 0, F.array_join("k", ",")).alias("kinds"))


def fallback_chains(attempts: DataFrame) -> DataFrame:
    """request_id, chain up to the first success, its model, and 502 where every attempt failed."""
    a = attempts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("ord", "model", "status"))).alias("a"))
    done = F.array_min(F.transform(F.filter("a", lambda x: x["status"] == 200), lambda x: x["ord"]))
    a = a.withColumn("done", done)
    used = F.filter("a", lambda x: F.col("done").isNull() | (x["ord"] <= F.col("done")))
    final = F.element_at(F.filter("a", lambda x: x["ord"] == F.col("done")), 1)["model"]
    chain = F.array_join(F.transform(used, lambda x: x["model"].cast("string")), " → ")
    return a.select("request_id", chain.alias("chain"), F.when(F.col("done").isNotNull(), final).alias("final_model"), F.when(F.col("done").isNull(), 502).otherwise(200).alias("status"))


def model_group(model: Column, prefix: str) -> Column:
    """The fallback group that a model name asks for: high, medium, low (or lite), with or without the gateway's prefix."""
    m = F.regexp_replace(T.ascii_lower(F.trim(model)), f"^{prefix}[/:-]", "")
    return F.when(m.isin("high", "medium", "low"), m).when(m == "lite", "low")


def protocol(path: Column, header: Column, body: Column) -> Column:
    """Header, then the body's shape where it fits one protocol alone, then the path."""
    blocks = F.regexp_count(body, F.lit(r'"type"\s*:\s*"(?:text|tool_use|tool_result)"')) > 0
    anthropic = (F.get_json_object(body, "$.system").isNotNull() & F.get_json_object(body, "$.messages").isNotNull()) | blocks
    openai = F.get_json_object(body, "$.tools").isNotNull() | F.get_json_object(body, "$.tool_choice").isNotNull() | body.rlike(r'"tool_calls"\s*:|"role"\s*:\s*"tool"')
    low = T.ascii_lower(path)
    by_path = F.when(low.contains("/messages") & ~low.contains("chat/completions"), "anthropic").otherwise("openai")
    return F.when(T.ascii_lower(header).isin("anthropic", "openai"), T.ascii_lower(header)).when(anthropic & ~openai, "anthropic").when(openai & ~anthropic, "openai").otherwise(by_path)
