"""From turns to typed events, critic scores and daily reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import text as T

#: Summary limits and confidences by kind.
LIMITS = {"goal": 240, "sub_goal": 240, "decision": 320, "result": 600, "reflection": 500, "observation": 600, "arguments": 240}
CONFIDENCE = {"goal": 0.85, "sub_goal": 0.75, "decision": 0.75, "result": 0.7, "reflection": 0.6, "action": 0.95, "observation": 0.9, "state_transition": 0.8}
CALLS, RESULTS = "array<struct<name:string,arguments:string>>", "array<string>"


def action(call: Column) -> Column:
    """A tool call as name(arguments), the name by its use; without arguments the name alone."""
    name, args = T.tool_name(call["name"], call["arguments"]), T.truncate(F.coalesce(call["arguments"], F.lit("")), LIMITS["arguments"])
    return F.when(args == "", name).otherwise(F.concat(name, F.lit("("), args, F.lit(")")))


def turn_events(messages: DataFrame, run: str, turn: str) -> DataFrame:
    """run, turn, seq, kind, summary, confidence of messages (role, text; tool_calls, tool_results and response if there).

    A message of the request gives a user's goal or sub-goal, its calls' actions, its results' observations, an assistant's
    decision. The response (an assistant's message, unless `response` says otherwise) gives a decision, a result or else,
    without calls, a reflection, and each call's action and the state that it enters."""
    t = F.coalesce("text", F.lit(""))
    has = messages.columns
    calls = F.coalesce("tool_calls", F.array().cast(CALLS)) if "tool_calls" in has else F.array().cast(CALLS)
    results = F.coalesce("tool_results", F.array().cast(RESULTS)) if "tool_results" in has else F.array().cast(RESULTS)
    said = F.coalesce("response", F.lit(False)) if "response" in has else F.col("role") == "assistant"
    m = messages.select(run, turn, "role", t.alias("text"), calls.alias("calls"), results.alias("results"), said.alias("said"))
    t = F.col("text")
    asks = (F.col("role") == "user") & (F.trim(t) != "") & ~F.col("said")
    nth = F.sum(asks.cast("int")).over(Window.partitionBy(run).orderBy(turn, "said").rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("asks", asks).withColumn("nth", nth).withColumn("dec", T.decision(t)).withColumn("done", T.looks_like_result(t))

    def event(kind: Column | str, summary: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), summary.alias("summary"))

    none = F.array().cast("array<struct<kind:string,summary:string>>")
    acts = F.transform("calls", lambda c: event("action", action(c)))
    request = F.concat(
        F.when(F.col("asks"), F.array(event(F.when(F.col("nth") == 1, "goal").otherwise("sub_goal"), T.truncate(F.trim(t), LIMITS["goal"])))).otherwise(none),
        acts, F.transform("results", lambda r: event("observation", T.truncate(r, LIMITS["observation"]))),
        F.when((F.col("role") == "assistant") & F.col("dec").isNotNull(), F.array(event("decision", F.col("dec")))).otherwise(none),
    )
    enters = F.flatten(F.transform("calls", lambda c: F.array(event("action", action(c)), F.when(T.tool_state(c["name"], c["arguments"]).isNotNull(), event("state_transition", T.tool_state(c["name"], c["arguments"]))))))
    ends = F.when(F.col("done"), event("result", T.truncate(t, LIMITS["result"]))).when(F.size("calls") == 0, event("reflection", T.truncate(t, LIMITS["reflection"])))
    words = F.when(F.trim(t) != "", F.array(F.when(F.col("dec").isNotNull(), event("decision", F.col("dec"))), ends)).otherwise(none)
    response = F.concat(words, enters)
    e = m.select(run, turn, "said", F.posexplode(F.array_compact(F.when(F.col("said"), response).otherwise(request))).alias("sub", "e"))
    seq = (F.row_number().over(Window.partitionBy(run).orderBy(turn, "said", "sub")) - 1).cast("long")
    conf = F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p])
    return e.withColumn("seq", seq).select(run, turn, "seq", "e.kind", "e.summary", conf[F.col("e.kind")].alias("confidence"))


def critic(events: DataFrame, run: str, turn: str) -> DataFrame:
    """Five scores and the outcome of each run, from one pass of conditional counts. `finding` marks events that broke a policy."""
    kind, text = F.col("kind"), F.col("summary")
    action = kind == "action"
    edits = action & (text.contains("Edit") | text.contains("Write(") | text.contains("patch") | text.contains("ApplyPatch"))
    risky = action & (text.contains("rm -rf") | (text.contains("delete") & text.contains("all")))
    c = events.groupBy(run).agg(
        F.countDistinct(turn).alias("turns"), F.bool_or(kind.isin("goal", "sub_goal")).alias("goal"), F.bool_or(kind == "result").alias("result"), F.bool_or(kind == "observation").alias("seen"),
        F.count_if(action).alias("actions"), F.countDistinct(F.when(action, text)).alias("kinds"), F.bool_or(edits).alias("edits"), F.bool_or(risky).alias("risky"), F.bool_or("finding").alias("finding"),
        F.bool_or((kind == "state_transition") & (text == "Verification")).alias("verified"),
    )
    task = F.when(F.col("edits"), "coding").when(F.col("actions") > 0, "explore").otherwise("chat")
    explore = F.when(F.col("result"), 90).when(F.col("seen") & (F.col("actions") > 0), 75).when(F.col("actions") == 0, 40).otherwise(60)
    coding = F.when(F.col("verified"), 85).when(F.col("actions") == 0, 40).otherwise(65)
    chat = F.when(F.col("result"), 85).when(F.col("turns") <= 2, 70).otherwise(60)
    c = c.withColumn("task", task).withColumn("completeness", F.when(F.col("task") == "explore", explore).when(F.col("task") == "coding", coding).otherwise(chat))
    n = F.col("turns")
    return c.select(
        run, "task", F.when(F.col("goal"), 85).otherwise(55).alias("alignment"), "completeness", F.when(F.col("actions") > 2 * F.col("kinds"), 50).otherwise(80).alias("necessity"),
        F.when(n <= 5, 90).when(n <= 15, 75).when(n <= 30, 60).otherwise(45).alias("efficiency"), F.when(F.col("finding"), 35).when(F.col("risky"), 40).otherwise(90).alias("safety"),
        F.when(F.col("result"), "success").when(n == 0, "unknown").when(F.col("completeness") >= 70, "partial").otherwise("unknown").alias("outcome"),
    )


def daily(days: DataFrame) -> DataFrame:
    """Counts of each day's runs, and a fingerprint that changes with any of them. A day's runs are bounded by its own traffic;
    the fingerprint is made from per-run lines, sorted."""
    line = F.concat_ws(":", *[F.col(c).cast("string") for c in ("user_id", "run_no", "turns", "status", "tokens")])
    got = days.withColumn("line", line).groupBy("day_no").agg(
        F.countDistinct("user_id").alias("agents"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "running").alias("running"), F.sum("turns").alias("turns"), F.sum("tokens").alias("tokens"), F.md5(F.array_join(F.array_sort(F.collect_list("line")), "|")).alias("fingerprint"))
    return got.select("day_no", "agents", "runs", "completed", "failed", "running", "turns", "tokens", "fingerprint")


def markdown(reports: DataFrame) -> DataFrame:
    lines = F.concat_ws(
        "\n", F.format_string("# Agents, day %d", "day_no"), F.lit("## Overview"), F.format_string("- Active agents: %d", "agents"),
        F.format_string("- Completed: %d / In progress: %d / Failed: %d", "completed", "running", "failed"), F.format_string("- Turns: %d", "turns"), F.format_string("- Tokens: %d", "tokens"))
    return reports.withColumn("body", lines)


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html(reports: DataFrame) -> DataFrame:
    def tile(name: str) -> Column:
        return F.concat(F.lit("<div class=tile><b>"), escape(F.col(name).cast("string")), F.lit(f"</b> {name}</div>"))

    def bar(name: str) -> Column:
        return F.format_string(f"<i class={name} style='width:%d%%'></i>", F.floor(F.col(name) * 100 / F.greatest(F.lit(1), F.col("runs"))))

    return reports.select("day_no", F.concat(F.lit("<section>"), *[tile(n) for n in ("agents", "runs", "turns", "tokens")], F.lit("<div class=bar>"), *[bar(n) for n in ("completed", "running", "failed")], F.lit("</div></section>")).alias("body"))


def top_distinct(rows: DataFrame, key: str, text: str, order: str, most: int) -> DataFrame:
    """The first `most` different texts of each key, by their first place; pre-aggregated before the window."""
    first = rows.groupBy(key, text).agg(F.min(order).alias("_at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("_at", text))).where(F.col("n") <= most)
