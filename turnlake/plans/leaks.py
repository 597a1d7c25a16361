"""Scans of documents for passages of a protected corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import leakscan, sequences
from turnlake.plans.texts import NORM
from turnlake.registry import query
from turnlake.sources.tables import read

FRAGMENTS = f"""with d as (select doc_id, {NORM.format('text')} t from documents), b as (select item_id, {NORM.format('text')} t from benchmark),
w as (select distinct item_id, substr(t, cast(i as bigint), 65) f from (select item_id, t, unnest(range(1, length(t) - 63)) i from b)), x as (select distinct doc_id, substr(t, cast(i as bigint), 65) f from (select doc_id, t, unnest(range(1, length(t) - 63)) i from d))"""


@query("jn6_fn18_shared_fragments", FRAGMENTS + " select distinct doc_id, item_id from x join w using (f)")
def jn6(spark, sf_dir):
    found = leakscan.shared_fragments(read(spark, sf_dir, "documents"), "doc_id", read(spark, sf_dir, "benchmark"), "item_id")
    return found.select("doc_id", "item_id").distinct()


@query("ca11_so5_leaked_ranges", FRAGMENTS.split("x as")[0] + """x as (select doc_id, i - 1 s, substr(t, cast(i as bigint), 65) f from (select doc_id, t, unnest(range(1, length(t) - 63)) i from d)),
m as (select distinct doc_id, s, s + 65 e from x semi join w using (f)), g as (select *, sum(n) over (partition by doc_id order by s) k from (select *, case when s > lag(e) over (partition by doc_id order by s) then 1 else 0 end n from m))
select doc_id, cast(min(s) as bigint) s, cast(max(e) as bigint) e from g group by doc_id, k""")
def ca11(spark, sf_dir):
    """Ranges of a document's normalised text that a protected item holds, at least 65 characters each, merged."""
    found = leakscan.shared_fragments(read(spark, sf_dir, "documents"), "doc_id", read(spark, sf_dir, "benchmark"), "item_id")
    return sequences.merge_ranges(found.select("doc_id", "s", "e"), ["doc_id"]).select("doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


@query("jn7_literal_needles", "select doc_id, n_name, cast((length(text) - length(replace(text, substr(n_name, 1, 3), ''))) / 3 as bigint) hits from documents, nation where contains(text, substr(n_name, 1, 3))")
def jn7(spark, sf_dir):
    """Each literal against each text; the 25 literals are folded into one array, so texts aren't joined with rules."""
    needles = read(spark, sf_dir, "nation").select("n_name")
    return leakscan.literals(read(spark, sf_dir, "documents"), "doc_id", needles.select("n_name", F.substring("n_name", 1, 3).alias("needle")), "n_name")


@query("jn8_most_specific_rules", """with m as (select n_nationkey k, '/' || n_regionkey || case when n_nationkey % 2 = 0 then '' else '/' || n_name end p from nation) select k, p from m where not exists (select 1 from m c where starts_with(c.p, m.p || '/'))""")
def jn8(spark, sf_dir):
    m = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("/"), F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("/"), "n_name"))).alias("p"))
    return leakscan.most_specific(m, "p")


_TOKENS = "list_distinct(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[" + leakscan._CJK + "]|[0-9a-zÀ-ɏ]+'))"
_OTHER = "regexp_matches({}, '[^\\P{{L}}A-Za-zÀ-ɏ" + leakscan._CJK + "]')"


@query("fn22_token_prefilter", f"""with d as (select doc_id, {_TOKENS.format('text')} t, {_OTHER.format('text')} o from documents), b as (select distinct {_TOKENS.format('text')} t, {_OTHER.format('text')} o from benchmark),
p as (select doc_id, list_intersect(d.t, b.t) s, d.o or b.o or len(d.t) = 0 or len(b.t) = 0 a, least(len(d.t), len(b.t)) n from d, b)
select doc_id, bool_and(not a and (len(s) = 0 or (len(list_filter(s, lambda x: length(x) >= 4)) = 0 and len(s) * 2 < n))) skipped from p group by doc_id""")
def fn22(spark, sf_dir):
    """Each document against every protected item, with the guards on other scripts, CJK tokens and empty sets."""
    return leakscan.item_prefilter(read(spark, sf_dir, "documents"), "doc_id", read(spark, sf_dir, "benchmark"))


@query("fn19_chunks", "select doc_id, cast(c as bigint) chunk, length(substr(text, cast(c * 8128 + 1 as bigint), 8192)) n from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil((length(text) - 64) / 8128.0) as bigint)))) c from documents)")
def fn19(spark, sf_dir):
    """Chunks of 8192 characters (code points, where the reference counts bytes) that overlap by 64."""
    return leakscan.chunks(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "chunk", F.length("part").cast("long").alias("n"))


@query("so2_so3_manifest_split", "with a as (select p_partkey k, p_size s, p_partkey % 3 = 0 changed from part) select k, case when changed then 'new' else 'same' end state from a")
def so2(spark, sf_dir):
    now = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"))
    before = now.select("path", F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return leakscan.manifest_split(now, before).select(F.col("path").alias("k"), "state")


@query("so5_range_merge", """with r as (select l_orderkey k, cast(l_partkey % 50 as bigint) s, cast(l_partkey % 50 + l_quantity as bigint) e from lineitem), f as (select *, case when s > max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end b from r),
g as (select *, sum(b) over (partition by k order by s, e rows unbounded preceding) g from f) select k, min(s) s, max(e) e from g group by k, g""")
def so5(spark, sf_dir):
    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("s"), (F.col("l_partkey") % 50 + F.col("l_quantity")).cast("long").alias("e"))
    return sequences.merge_ranges(r, ["k"])
