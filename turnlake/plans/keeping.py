"""Kept tables and files: each query writes below the shared folder and reads back."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from turnlake.operators import keeping, leakscan
from turnlake.plans.leaks import FRAGMENTS
from turnlake.plans.texts import NORM
from turnlake.registry import query
from turnlake.sources import files
from turnlake.sources.tables import RUNS_SQL, events, numbered, read, runs


@F.arrow_udf(BinaryType())
def _docx(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("word/document.xml", f"<d><p> {t} </p><p>&amp; end</p></d>")
            z.writestr("word/_rels/document.xml", "<d>not this</d>")
        out.append(held.getvalue())
    return pa.array(out, pa.binary())


@query("sc7_text_extraction", "select p_partkey, case p_partkey % 3 when 0 then p_name || ' & end' || chr(10) when 1 then p_name end text from part")
def sc7(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    ext = F.element_at(F.array(F.lit("docx"), F.lit("TXT"), F.lit("pdf")), (F.col("p_partkey") % 3 + 1).cast("int"))
    content = F.when(F.col("p_partkey") % 3 == 0, _docx("p_name")).otherwise(F.encode("p_name", "utf-8"))
    return files.document_text(p.select("p_partkey", F.concat(F.lit("/c/f."), ext).alias("path"), content.alias("content"))).select("p_partkey", "text")


@query("sk16_graphs", f"with {RUNS_SQL} select user_id || '-' || run_no run, turns nodes from runs")
def sk16(spark, sf_dir):
    """Half of the events first, then all: the graphs that were written last count."""
    path = files.scratch(spark, "graphs")
    ev = numbered(events(spark, sf_dir)).select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("run_no").cast("string")).alias("run"), "us", "event_id", "event_type")
    keeping.write_graphs(ev.where("event_id % 2 = 0"), "run", ["us", "event_id"], path)
    keeping.write_graphs(ev, "run", ["us", "event_id"], path)
    return keeping.graphs(spark, path).select("run", F.json_array_length(F.get_json_object("graph", "$.nodes")).cast("long").alias("nodes"))


@query("sk11_reset", f"with {RUNS_SQL} select 'events' as \"table\", count(*) as \"rows\" from events union all select 'runs', count(*) from runs union all select 'reports', 0")
def sk11(spark, sf_dir):
    path = files.scratch(spark, "kept")
    events(spark, sf_dir).write.parquet(f"{path}/events")
    runs(spark, sf_dir).write.parquet(f"{path}/runs")
    return keeping.reset(spark, path, ["events", "runs", "reports"])


@query("sk17_metadata", "select 'daily' as \"key\", 'true,false,true' due, '2024-01-02' as \"value\"")
def sk17(spark, sf_dir):
    path = files.scratch(spark, "meta")
    due = [str(keeping.once_a_day(spark, path, "daily", d)).lower() for d in ("2024-01-01", "2024-01-01", "2024-01-02")]
    return spark.createDataFrame([("daily", ",".join(due), keeping.get_metadata(spark, path, "daily"))], "key string, due string, value string")


@query("ca12_fn46_index_generations", f"""with b as (select item_id, {NORM.format('text')} t from benchmark) select item_id::varchar path, cast(length(t) - 32 as bigint) places from b where length(t) >= 65""")
def ca12(spark, sf_dir):
    """The second build meets half of its files in the first one, and hashes only the others."""
    path = files.scratch(spark, "index")
    c = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"), "text", "item_id")
    keeping.build_index(c.where("item_id % 2 = 0"), path)
    keeping.build_index(c, path)
    return keeping.index(spark, path).groupBy("path").agg(F.count(F.lit(1)).alias("places"))


@query("ca12_indexed_leak_scan", FRAGMENTS + " select distinct doc_id, item_id::varchar path from x join w using (f)")
def scan(spark, sf_dir):
    """Documents and files by the index, verified; equals the scan without an index (tested)."""
    path = files.scratch(spark, "index")
    c = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"), "text")
    keeping.build_index(c, path)
    docs = read(spark, sf_dir, "documents")
    near = keeping.candidates(docs, "doc_id", keeping.index(spark, path))
    some = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi")
    found = leakscan.shared_fragments(some, "doc_id", c.join(near.select("path").distinct(), "path", "left_semi"), "path")
    return found.select("doc_id", F.col("item_id").alias("path")).distinct()
