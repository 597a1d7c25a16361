"""Folders as sources: traffic snapshots, protected corpora, spilled turns; and the shared folder's small files.

All access is by Spark's readers or Hadoop's file system, so a folder can be in any store."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIDECAR = "id string, timestamp timestamp, session_id string, audit_id string, phase string, bytes long, saved_bytes long, truncated boolean, file_path string"
LEGACY = r"^(\d{8}T\d{6})_(.+).{9}$"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Unset, a temporary folder serves a local master (tests); a cluster must name one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(spark: SparkSession, path: str):
    """Hadoop's file system and path objects of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = store(spark, path)
    return fs.exists(p)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced whole: written beside its place and renamed into it."""
    fs, p = store(spark, path)
    _, fresh = store(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    if not fs.rename(fresh, p):  # stores that don't rename onto a file
        fs.delete(p, False)
        fs.rename(fresh, p)


def get(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    fs, p = store(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def traffic(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder's bodies: from sidecars whose body is there, else (older files) from the name alone.

    Bodies are listed, not read. A name without a time and a phase, and a sidecar that isn't JSON, give no record."""
    bodies = spark.read.format("binaryFile").option("pathGlobFilter", "*.body").load(folder).select(F.col("path").alias("file_path"), F.col("length").alias("_length"), F.regexp_replace(_name(F.col("path")), r"\.body$", "").alias("_stem"))
    metas = spark.read.schema(SIDECAR).option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(folder)
    metas = metas.select("*", F.regexp_replace(_name(F.col("_metadata.file_path")), r"\.meta\.json$", "").alias("_stem"))
    known = metas.where("id is not null").drop("file_path").join(bodies.select("_stem", "file_path"), "_stem")
    columns = [c.split()[0] for c in SIDECAR.split(", ")]
    old = bodies.join(metas.select("_stem").distinct(), "_stem", "left_anti").where(F.col("_stem").rlike(LEGACY))
    at = F.try_to_timestamp(F.regexp_extract("_stem", LEGACY, 1), F.lit("yyyyMMdd'T'HHmmss"))
    made = {"id": F.sha1("file_path"), "timestamp": at, "session_id": F.lit(""), "audit_id": F.lit(""), "phase": F.regexp_extract("_stem", LEGACY, 2), "bytes": F.col("_length"), "saved_bytes": F.col("_length"), "truncated": F.lit(False), "file_path": F.col("file_path")}
    return known.select(columns).unionByName(old.select(*[made[c].alias(c) for c in columns]).where("timestamp is not null"))


def corpus_files(spark: SparkSession, path: str, recursive: bool, formats: list[str]) -> DataFrame:
    """path, modificationTime, length, content of a rule's files. `path` may be one file, which is taken whatever its name; a
    missing path gives no rows. .env counts as txt."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    fs, p = store(spark, path)
    if fs.getFileStatus(p).isFile():
        return reader.load(path)
    if not recursive:  # subfolders aren't partitions here
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        root = fs.makeQualified(p).toUri().getPath().rstrip("/")
    files = reader.load(path)
    wanted = [f.lower() for f in formats]
    ext = F.lower(F.regexp_extract(_name(F.col("path")), r"^.*\.([^.]+)$", 1))
    # A name that is nothing but ".env" has no extension.
    files = files.where((ext.isin(wanted) | ((ext == "env") & F.lit("txt" in wanted))) & ~_name(F.col("path")).rlike(r"^\.[^.]*$"))
    if not recursive:
        files = files.where(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), "/[^/]*$", "") == root)
    return files


def _xml_text(data: bytes) -> str:
    """Text nodes, trimmed and joined by a space; what comes before an error stays."""
    parts, run = [], []

    def end(*_) -> None:
        if piece := "".join(run).strip():
            parts.append(piece)
        run.clear()

    parser = expat.ParserCreate()
    parser.CharacterDataHandler, parser.StartElementHandler, parser.EndElementHandler = run.append, end, end
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        pass
    end()
    return " ".join(parts)


def office_text(data: bytes | None, ext: str) -> str | None:
    """The text of a docx (word/*.xml) or pptx (slides and notes); null if it isn't readable or holds none."""
    def wanted(n: str) -> bool:
        if not n.endswith(".xml"):
            return False
        return n.startswith("word/") and "_rels/" not in n if ext == "docx" else n.startswith(("ppt/slides/slide", "ppt/notesSlides/notesSlide"))

    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            texts = [_xml_text(z.read(n)) for n in z.namelist() if wanted(n)]
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError):
        return None
    return "".join(t + "\n" for t in texts if t) or None


@F.arrow_udf(StringType())
def _office(content: pa.Array, ext: pa.Array) -> pa.Array:
    return pa.array([office_text(c, e) if e in ("docx", "pptx") else None for c, e in zip(content.to_pylist(), ext.to_pylist(), strict=True)], pa.string())


def document_text(files: DataFrame) -> DataFrame:
    """`files` (path, content, ...) with text. Office files go through Python, all others are UTF-8; PDF and the older office
    formats have no reader here and give null."""
    e = files.withColumn("_ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    office, none = F.col("_ext").isin("docx", "pptx"), F.col("_ext").isin("pdf", "doc", "ppt")
    own = e.where(office).withColumn("text", _office("content", "_ext"))
    plain = e.where(~office).withColumn("text", F.when(~none, F.expr("validate_utf8(make_valid_utf8(cast(content as string)))")))
    return own.unionByName(plain).drop("_ext")


def spilled(spark: SparkSession, folder: str, schema: str, archive: str | None = None, per_batch: int = 1000) -> DataFrame:
    """Spilled turns (JSON files) as a stream, oldest first; read files are deleted, or moved to `archive`."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false").option("maxFilesPerTrigger", per_batch).option("cleanSource", "archive" if archive else "delete")
    return (reader.option("sourceArchiveDir", archive) if archive else reader).json(folder)


def spill_state(spark: SparkSession, folder: str) -> DataFrame:
    """One row: pending files and the oldest one's time (null if none)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.agg(F.count(F.lit(1)).alias("pending"), F.min("modificationTime").alias("oldest"))
