"""Shared helpers of the training-data operators: shared storage, bounded samples, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: spark.checkpoint.dir. Unset, a temporary folder serves a local
    master (tests); on a cluster it would be one machine's, so that is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        at = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of an id's decimal text, mod `mod`; null ids give null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % F.lit(mod)


def hash_fraction(col: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the value and the seed; samples drawn with it don't depend on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 30)) / F.lit(float(1 << 30))


def skew_lookup(main: DataFrame, key: str, looked_up: DataFrame, weights: DataFrame, total: int, share: int = 500, least: int = 200, how: str | None = None) -> DataFrame:
    """Left join of `main` with `looked_up` (one row a key) on `key` where few keys may hold most rows of `main`.

    `weights` has (key, n): how many rows of `main` hold it. Keys with more than total/share rows are at most `share`
    in number, whatever the data, so their rows are broadcast; rows of those keys get null keys spread over a salt in
    the shuffled join of all others. Null keys find nothing. `how` is a join hint for the others: with "shuffle_hash" the
    plan has the same shape at every size."""
    kind = dict(main.dtypes)[key]
    heavy = weights.where(F.col("n") > max(least, total // share)).select(F.col(key).alias("_hot"))
    values = [c for c in looked_up.columns if c != key]
    hot = looked_up.join(F.broadcast(heavy), F.col(key) == F.col("_hot"), "inner").drop(key)
    cold = looked_up.join(F.broadcast(heavy), F.col(key) == F.col("_hot"), "left_anti")
    hot = hot.select("_hot", F.struct(*values).alias("_h"))
    cold = cold.select(F.col(key).alias("_cold"), F.lit(0).cast("long").alias("_csalt"), F.struct(*values).alias("_c"))
    cold = cold.hint(how) if how else cold
    m = main.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    m = m.withColumn("_mkey", F.when(F.col("_hot").isNull(), F.col(key)).cast(kind))
    m = m.withColumn("_msalt", F.when(F.col("_mkey").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0).cast("long")))
    out = m.join(cold, (F.col("_mkey") == F.col("_cold")) & (F.col("_msalt") == F.col("_csalt")), "left")
    return out.select(*[out[c] for c in main.columns], *[F.coalesce(F.col(f"_h.{c}"), F.col(f"_c.{c}")).alias(c) for c in values])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int) -> list[tuple[str, int]]:
    """At most about `rows` (text, label) pairs, fixed by doc_id, of labelled documents whose crc32(doc_id) mod 5 is not 0.

    `rows` bounds what reaches the driver. A doc_id with several labels takes the larger; null ids, labels and texts
    don't take part."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where((crc_mod("_id", 5) != 0) & F.col("_y").isNotNull())
    n = lab.count()
    if not n:
        return []
    lab = lab.where(hash_fraction(F.col("_id"), seed) < min(1.0, rows / n)).groupBy("_id").agg(F.max("_y").alias("_y"))
    got = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(lab), F.col("doc_id") == F.col("_id")).where("text is not null")
    return [(r.text, r._y) for r in sorted(got.select("doc_id", "text", "_y").collect(), key=lambda r: (r.doc_id, r.text))]


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores before it as it takes to clash with no other."""
    while name.lower() in map(str.lower, taken):
        name = "_" + name
    return name


#: Rows whose texts a worker holds as Python objects at a time.
SLICE = 1024
_tables: dict[str, object] = {}
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts have SLICE rows unless the session says otherwise: at Spark's 10 000, one is as large as its texts
    are, twice over in the JVM while a vector grows, and once more in the worker."""
    if int(spark.conf.get(_ROWS)) == 10_000:
        spark.conf.set(_ROWS, str(SLICE))


def worker_table(name: str, make: Callable[[], object]) -> object:
    """The worker's table of that name, which its tasks share. A worker holds the tables of one stage: `slices` lets others go."""
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def slices(batches: Iterator[pa.RecordBatch], table: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of a task in parts of SLICE rows. Tables but that of the name `table`, left by tasks of other stages, and
    memory that Arrow keeps for later are given back, so a worker's memory doesn't grow from stage to stage."""
    for name in [n for n in _tables if n != table]:
        del _tables[name]
    pool = pa.default_memory_pool()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
        del batch
        pool.release_unused()


def append(rows: DataFrame, text: str, added: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """All rows and columns, and then the columns `added` (a schema): make() is called once a task and gives a function from a
    batch's texts to a list of each added column's values. Names that `rows` has already get underscores before them."""
    small_batches(rows.sparkSession)
    fields = [T.StructField(fresh(f.name, rows.columns), f.dataType) for f in T._parse_datatype_string(added).fields]
    at = rows.columns.index(text)
    schema = T.StructType(rows.schema.fields + fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in slices(batches):
            new = fn(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(new, kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


class Memo(dict):
    """value = make(key). At most `limit` keys are held, and none beyond LONG characters (bounded memory in a worker); once full, new keys are made anew each
    time, until four times as many have been: then all are dropped, so a changed vocabulary is learned."""

    LONG = 256

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.missed = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        if isinstance(key, str) and len(key) > self.LONG:
            return value
        if len(self) >= self.limit:
            self.missed += 1
            if self.missed < 4 * self.limit:
                return value
            self.missed = 0
            self.clear()
        self[key] = value
        return value
