"""Operators over ordered events: day overlap, patterns, graphs, batches, trigger windows, range merges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def by_day(runs: DataFrame) -> DataFrame:
    """A row for each day that a run overlaps: the interval join, by exploding the run's own days instead of joining a calendar."""
    return runs.withColumn("day_no", F.explode(F.sequence(F.expr(f"started div {DAY}"), F.expr(f"ended div {DAY}"))))


def patterns(steps: DataFrame, keys: list[str], order: str, label: str, least: int = 2, top: int = 20) -> DataFrame:
    """2- and 3-grams of labels (trimmed, 48 characters), counted by the status of their sequence.

    Support below `least` goes; a mixed pattern needs 3. Ties go to the lesser gram. Counts are pre-aggregated map-side."""
    w = Window.partitionBy(*keys).orderBy(order)
    a = F.substring(F.trim(F.col(label)), 1, 48)
    s = steps.withColumn("_a", a).withColumn("_b", F.lead("_a").over(w)).withColumn("_c", F.lead("_a", 2).over(w))
    two = F.when(F.col("_b").isNotNull(), F.struct(F.concat_ws(" → ", "_a", "_b").alias("gram"), F.lit(2).alias("n")))
    three = F.when(F.col("_c").isNotNull(), F.struct(F.concat_ws(" → ", "_a", "_b", "_c").alias("gram"), F.lit(3).alias("n")))
    g = s.select("status", F.explode(F.array_compact(F.array(two, three))).alias("g"))
    g = g.groupBy("g.gram", "g.n").agg(F.count_if(F.col("status") == "completed").alias("success"), F.count_if(F.col("status") == "failed").alias("failure"))
    support = F.col("success") + F.col("failure")
    mixed = (F.col("success") > 0) & (F.col("failure") > 0)
    hint = F.when(F.col("failure") == 0, "success").when(F.col("success") == 0, "failure").otherwise("mixed")
    return g.where((support >= least) & (~mixed | (support >= 3))).withColumn("hint", hint).orderBy(F.desc(support), "gram").limit(top)


def summary(steps: DataFrame, keys: list[str], order: str, label: str, first: int = 8) -> DataFrame:
    own = steps.where(F.col(order) < first).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.substring(label, 1, 40).alias("l")))).alias("x"))
    return own.select(*keys, F.array_join(F.transform("x", lambda s: s["l"]), " → ").alias("summary"))


def parallel(steps: DataFrame, keys: list[str], order: str, kind: str, audit: str, action: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    same = (F.col(kind) == action) & (F.lag(kind).over(w) == action) & (F.lag(audit).over(w) == F.col(audit))
    return steps.withColumn("parallel", F.coalesce(same, F.lit(False)))


def graph_edges(steps: DataFrame, keys: list[str], order: str, kind: str, audit: str) -> DataFrame:
    """keys, node, parent, label: the parent of each event of a sequence. `order` counts the events of a key.

    The root, the chain's tip and the tips of decisions and actions are each the last event of some kinds before, so all come
    from one sorted window in time linear in the sequence. An action right after an action of its audit has that one's parent."""
    w = Window.partitionBy(*keys).orderBy("_o")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    k, n = F.col("_k"), F.col("_n")

    def among(*kinds: str) -> Column:
        return F.coalesce(k.isin(*kinds), F.lit(False))

    def tip(those: Column, held: Column | None = None) -> Column:
        """The last of `those` events before, if it is a `held` one."""
        own = F.when(those, F.struct(F.when(F.lit(True) if held is None else held, n).alias("n")))
        return F.last(own, ignorenulls=True).over(before)["n"]

    s = steps.select(*keys, F.col(order).alias("_o"), F.col(order).cast("int").alias("_n"), F.col(kind).alias("_k"), F.col(audit).cast("string").alias("_a"))
    twin = among("action") & (F.lag("_k").over(w) == "action") & (F.lag("_a").over(w) == F.col("_a"))
    s = s.select(
        "*", F.coalesce(twin, F.lit(False)).alias("_twin"), tip(among("goal", "sub_goal")).alias("_root"), tip(~among("action")).alias("_chain"),
        tip(~among("action", "state_transition"), among("decision")).alias("_dec"), tip(among("action", "goal", "sub_goal", "decision"), among("action")).alias("_act"),
    )
    root, chain, dec, act = (F.col(c) for c in ("_root", "_chain", "_dec", "_act"))
    alone = (
        F.when(k == "sub_goal", root).when(k == "goal", F.lit(None)).when(k == "decision", F.coalesce(act, dec, chain)).when(k == "action", F.coalesce(dec, chain, act))
        .when(k.isin("observation", "state_transition"), F.coalesce(act, chain)).otherwise(F.coalesce(chain, act, dec))
    )
    parent = F.last(F.when(~F.col("_twin"), F.struct(alone.alias("p"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["p"]
    label = (
        F.when(k == "sub_goal", "sub-goal").when(k == "decision", "decides").when(F.col("_twin"), "acts").when(k == "action", F.when(dec.isNotNull(), "executes").otherwise("acts"))
        .when(k == "observation", "observes").when(k == "state_transition", "enters").when(k == "result", "results in").otherwise("reflects")
    )
    return s.select(*keys, n.alias("node"), parent.alias("parent"), label.alias("label")).where("parent is not null and parent <> node")


def token_batches(steps: DataFrame, keys: list[str], order: str, cost: str, limit: int) -> DataFrame:
    """keys, order, batch: a new batch begins where adding the line would exceed `limit`; a first line too large stays alone, and
    null costs count as zero.

    Where a batch begins depends on all before it, which no window says; a task reads its sorted rows one after the other and
    holds one sequence's batch number and sum."""
    d = steps.select(*keys, F.col(order).cast("long").alias(order), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("batch"))
    d = d.repartition(*keys).sortWithinPartitions(*keys, order)
    out = d.withColumn("batch", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, used = None, 0, 0
        for rows in batches:
            numbers = []
            for own, c in zip(zip(*[rows.column(k).to_pylist() for k in keys]), rows.column("batch").to_pylist()):
                if own != last:
                    last, number, used = own, 0, 0
                if used > 0 and used + c > limit:
                    number, used = number + 1, 0
                used += c
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(numbers, pa.int32())], names=rows.schema.names)

    return d.mapInArrow(run, out)


def armed(calls: DataFrame, session: str, order: list[str], trigger: Column, window: int) -> DataFrame:
    """calls with `active`: a trigger was among the last `window` calls of the session."""
    w = Window.partitionBy(session).orderBy(*order)
    n = calls.withColumn("_n", F.row_number().over(w))
    n = n.withColumn("_last", F.max(F.when(trigger, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return n.withColumn("active", F.coalesce(F.col("_n") - F.col("_last") < window, F.lit(False))).drop("_n", "_last")


def merge_ranges(ranges: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """keys, s, e: overlapping or touching ranges joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    r = r.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_g").agg(F.min(start).alias("s"), F.max(end).alias("e")).drop("_g")
