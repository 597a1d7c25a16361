"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the share of its host's pages that hold it; lines whose ratio exceeds
`ratio`, on at least `least_hits` pages, are boilerplate and are dropped wherever they stand in that host's pages, however few. Lines are compared by two 64-bit hashes of their stripped text; blank lines are kept and not counted.

A host holds at most (its lines a page / ratio) boilerplate lines, so they fit an array on the host's row. Counting is
pre-aggregated and keyed by (host, line); hosts' arrays reach the pages through a skew-safe lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import fresh, materialise, skew_lookup, table

RATIO, LEAST_HITS = 0.1, 2


def _hash(line: Column) -> Column:
    """A struct of two hashes of the stripped line; null for a blank one."""
    s = F.trim(F.regexp_replace(line, r"[\t\r]", " "))
    return F.when(s != "", F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit(77), s).alias("b")))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_hits: int = LEAST_HITS) -> DataFrame:
    """host, pages, drops array<struct<a,b>>: one row a host that has boilerplate. Null hosts are one host, ''."""
    own = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("t"))
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = own.select("host", F.explode(F.array_distinct(F.transform(F.split("t", "\n"), _hash))).alias("line")).where("line is not null")
    counts = lines.groupBy("host", F.col("line.a").alias("a"), F.col("line.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.where(F.col("n") >= least_hits), "line-counts")
    # A host with most of all lines is spread over many tasks.
    held = materialise(counts.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host-lines")
    over = skew_lookup(counts, "host", totals, held, held.agg(F.sum("n")).first()[0] or 0).where(F.col("n") > F.col("pages") * ratio)
    return over.groupBy("host").agg(F.first("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("drops"))


def drop_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_hits: int = LEAST_HITS) -> DataFrame:
    """All rows and columns of `pages`, with boilerplate lines gone from the text, and a last column `lines_dropped` (with underscores before it where that name is taken).

    Null texts stay null; a page of boilerplate alone becomes empty; rows are never dropped. Empty table: no rows."""
    plain = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"))
    drops = materialise(boilerplate(pages, host, text, ratio, least_hits), "boilerplate").select("host", "drops")
    weights = materialise(plain.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    total = weights.agg(F.sum("n")).first()[0] or 0
    names = pages.columns
    main = pages.select(F.struct(*names).alias("_row"), F.coalesce(F.col(host), F.lit("")).alias("host"))
    got = skew_lookup(main, "host", drops, weights, total)
    lines = F.split(F.col(f"_row.{text}"), "\n")
    kept = F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.col("drops"), _hash(x)), F.lit(True)))
    got = got.withColumn("_lines", lines).withColumn("_kept", F.when(F.col("drops").isNull(), F.col("_lines")).otherwise(kept))
    cols = [F.array_join("_kept", "\n").alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in names]
    return got.select(*cols, (F.size(F.coalesce("_lines", F.array())) - F.size(F.coalesce("_kept", F.array()))).alias(fresh("lines_dropped", names)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's kept text by digest and length, and how many lines went."""
    got = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"), F.col("lines_dropped").cast("long").alias("lines_dropped"))


ORACLE = r"""
with pages as (select doc_id, coalesce(source, '') host, text, row_number() over () rid from documents),
l as (select rid, host, i, string_split(text, chr(10))[i] line from (select rid, host, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from pages where text is not null)),
s as (select *, trim(regexp_replace(line, '[\t\r]', ' ', 'g'), ' ') k from l),
tot as (select host, count(*) pages from pages group by host),
c as (select host, k, count(distinct rid) n from s where k <> '' group by host, k),
bad as (select c.host, c.k from c join tot using (host) where n >= 2 and n > pages * 0.1),
j as (select s.rid, s.i, s.line, bad.k is not null gone from s left join bad on s.host = bad.host and s.k = bad.k),
r as (select rid, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') kept, count(*) filter (where gone) g from j group by rid)
select doc_id, cast(length(kept) as bigint) kept_chars, md5(kept) kept_md5, cast(coalesce(g, 0) as bigint) lines_dropped from pages left join r using (rid)
"""
