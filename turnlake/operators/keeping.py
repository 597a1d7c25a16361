"""Tables and small files that are kept: graphs, metadata, reset, and a leak index in generations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import text as T
from turnlake.operators.leakscan import LEAST, manifest_split, places
from turnlake.sources import files


def write_graphs(nodes: DataFrame, run: str, order: list[str], path: str) -> None:
    """Appends one JSON graph a run, its nodes in order. Rows, not a file each: runs are many and their graphs small.

    A run's whole graph is one value, as it is one document. Runs that are written again are told apart by their time."""
    fields = [c for c in nodes.columns if c != run]
    node = F.struct(*[F.col(c) for c in [*order, *[c for c in fields if c not in order]]])
    g = nodes.groupBy(F.col(run).alias("run")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(node)).alias("nodes")), {"pretty": "true"}).alias("graph"))
    g.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def graphs(spark: SparkSession, path: str) -> DataFrame:
    """run, graph: the last one written of each run."""
    return spark.read.parquet(path).groupBy("run").agg(F.max_by("graph", F.struct("written", "graph")).alias("graph"))


def put_reports(rows: DataFrame, key: str, path: str) -> None:
    """Appends one JSON payload a key; the last one written counts, so a report is replaced without touching the others."""
    rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("payload"), F.current_timestamp().alias("written")).write.mode("append").parquet(path)


def reports(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The columns of `schema` of each key's last payload."""
    last = spark.read.parquet(path).groupBy("key").agg(F.max_by("payload", F.struct("written", "payload")).alias("payload"))
    return last.select(F.from_json("payload", schema).alias("r")).select("r.*")


def put_metadata(spark: SparkSession, folder: str, key: str, value: str) -> None:
    files.put(spark, f"{folder}/{key}.json", json.dumps({"key": key, "value": value}))


def get_metadata(spark: SparkSession, folder: str, key: str) -> str | None:
    found = files.get(spark, f"{folder}/{key}.json")
    return None if found is None else json.loads(found)["value"]


def once_a_day(spark: SparkSession, folder: str, key: str, day: str) -> bool:
    """Whether the key's job is due on this day; if so, the day is noted."""
    if get_metadata(spark, folder, key) == day:
        return False
    put_metadata(spark, folder, key, day)
    return True


def reset(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    """table, rows: the rows that each table had; then they are gone. A missing table counts 0."""
    counts = [(t, spark.read.parquet(f"{folder}/{t}").count() if files.exists(spark, f"{folder}/{t}") else 0) for t in tables]
    for t in tables:
        fs, p = files.store(spark, f"{folder}/{t}")
        fs.delete(p, True)
    return spark.createDataFrame(counts, "table string, rows long")


def windows(corpus: DataFrame, least: int = LEAST) -> DataFrame:
    """path, h: a hash for each place's window of (least + 1) / 2 normalised characters."""
    w = (least + 1) // 2
    t = corpus.select("path", T.normalised(F.col("text")).alias("t")).where(F.length("t") >= least)
    return places(t, "path", "t", w, 1, 0).select("path", F.xxhash64(F.substring(F.col("part"), F.col("rel") + 1, F.lit(w))).alias("h"))


def generation(spark: SparkSession, folder: str) -> int:
    """The number of the generation that readers see; 0 if none."""
    return int(files.get(spark, f"{folder}/current") or 0)


def build_index(corpus: DataFrame, folder: str) -> int:
    """Indexes corpus (path, size, text) as a new generation and points readers to it; gives its number.

    Files whose path and size are as before keep their rows; others are hashed. Readers of the old generation aren't disturbed, and a
    build that fails leaves the pointer as it was: its half-written generation is replaced by the next build."""
    spark = corpus.sparkSession
    old = generation(spark, folder)
    before = spark.read.parquet(f"{folder}/gen={old}/manifest") if old else spark.createDataFrame([], "path string, size long")
    state = manifest_split(corpus.select("path", F.col("size").cast("long").alias("size")), before)
    rows = windows(corpus.join(state.where("state = 'new'").select("path"), "path", "left_semi"))
    if old:
        kept = spark.read.parquet(f"{folder}/gen={old}/index")
        rows = rows.unionByName(kept.join(state.where("state = 'same'").select("path"), "path", "left_semi"))
    new = f"{folder}/gen={old + 1}"
    rows.write.mode("overwrite").parquet(f"{new}/index")
    corpus.select("path", F.col("size").cast("long").alias("size")).write.mode("overwrite").parquet(f"{new}/manifest")
    files.put(spark, f"{folder}/current", str(old + 1))
    return old + 1


def index(spark: SparkSession, folder: str) -> DataFrame:
    """path, h of the current generation."""
    return spark.read.parquet(f"{folder}/gen={generation(spark, folder)}/index")


def candidates(docs: DataFrame, doc_id: str, rows: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, path: files that may share `least` characters with a document. Every shared range of that length holds one of
    the document's windows (one at every w-th place) whole, so none is missed; `leakscan.shared_fragments` verifies."""
    w = (least + 1) // 2
    d = docs.select(F.col(doc_id).alias("doc_id"), T.normalised(F.col("text")).alias("t")).where(F.length("t") >= least)
    d = places(d, "doc_id", "t", w, w, 0)
    return d.select("doc_id", F.xxhash64(F.substring(F.col("part"), F.col("rel") + 1, F.lit(w))).alias("h")).join(rows.distinct(), "h").select("doc_id", "path").distinct()
