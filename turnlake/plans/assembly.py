"""Run assembly over conversations, each a session; ten agents share them."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.registry import query
from turnlake.sources.tables import turns
from turnlake.streaming import runs as R


def session_turns(spark, sf_dir):
    t = turns(spark, sf_dir).where("role = 'user'")
    us = (F.col("conv_id") * 7200 + F.col("turn") * 600).cast("long") * 1_000_000
    return t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("audit_id"), F.concat(F.lit("agent-"), (F.col("conv_id") % 10).cast("string")).alias("agent"), F.col("conv_id").cast("string").alias("session"), us.alias("us"), "text")


@query("ca2_st3_jn10_run_assembly")
def ca2(spark, sf_dir):
    """Stateful: tests compare batch with stream."""
    return R.assemble(session_turns(spark, sf_dir))
