"""Passages that documents share with a protected corpus, and the filters before that join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text as T

LEAST = 65
#: Windows of a part that is scanned as one text.
SPAN = 32


def shared_fragments(docs: DataFrame, doc_id: str, corpus: DataFrame, item_id: str, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, s, e: ranges of at least `least` normalised characters that a document and an item share.

    The corpus gives a window of w = (least + 1) / 2 characters at each place, a document one at every w-th place alone: a
    shared range of 2w - 1 holds one of these whole. So documents send 1/w rows a character to the equi-join on the
    window's hash, and every candidate is verified and extended to its full length on both sides."""
    w = (least + 1) // 2
    d = docs.select(F.col(doc_id).alias("doc_id"), T.normalised(F.col("text")).alias("t")).where(F.length("t") >= least)
    # Only the block's surroundings travel: what lies within `least` of it decides whether it is part of a long enough range.
    d = places(d, "doc_id", "t", w, w, least).select("doc_id", "at", F.xxhash64(F.substring(F.col("part"), F.col("rel") + 1, F.lit(w))).alias("h"), _around("part", F.col("rel"), w, least).alias("x"))
    b = corpus.select(F.col(item_id).alias("item_id"), T.normalised(F.col("text")).alias("u")).where(F.length("u") >= least)
    b = places(b, "item_id", "u", w, 1, least).select("item_id", F.xxhash64(F.substring(F.col("part"), F.col("rel") + 1, F.lit(w))).alias("h"), _around("part", F.col("rel"), w, least).alias("y"))
    j = d.join(b, "h")
    same = F.sequence(F.lit(1), F.lit(least))
    left = _run(same, F.reverse(F.col("x.l")), F.reverse(F.col("y.l")))
    right = _run(same, F.col("x.r"), F.col("y.r"))
    j = j.where(F.col("x.m") == F.col("y.m")).withColumn("l", left).withColumn("r", right).where(F.col("l") + F.col("r") + w >= least)
    return j.select("doc_id", "item_id", (F.col("at") - F.col("l")).alias("s"), (F.col("at") + w + F.col("r")).alias("e")).distinct()


def places(rows: DataFrame, key: str, text: str, w: int, step: int, least: int) -> DataFrame:
    """key, at, part, rel: every step-th place of a window of `w` characters, as place `rel` of a part of the text that reaches
    `least` characters beyond the window on both sides where the text does.

    A substring is found by walking its text from the start, so the text is first cut into parts of SPAN windows, and the
    walks for the places are as long as a part. `step` must divide w."""
    span = SPAN * w
    n = F.length(text)
    d = rows.select(key, text, n.alias("n"), F.explode(F.sequence(F.lit(0), n - w, F.lit(span))).alias("base"))
    lead = F.least(F.col("base"), F.lit(least))
    d = d.select(key, "n", "base", lead.alias("lead"), F.substring(F.col(text), F.col("base") - lead + 1, lead + span + w + least).alias("part"))
    d = d.select(key, "base", "lead", "part", F.explode(F.sequence(F.col("base"), F.least(F.col("base") + span - step, F.col("n") - w), F.lit(step))).alias("at"))
    return d.select(key, "at", "part", (F.col("at") - F.col("base") + F.col("lead")).alias("rel"))


def _around(text: str, at: Column, w: int, least: int) -> Column:
    t, start = F.col(text), F.greatest(F.lit(0), at - least)
    return F.struct(F.substring(t, start + 1, at - start).alias("l"), F.substring(t, at + 1, F.lit(w)).alias("m"), F.substring(t, at + w + 1, F.lit(least)).alias("r"))


def _run(places: Column, a: Column, b: Column) -> Column:
    """How many characters two texts share from their starts: the last place up to which their heads are equal."""
    return F.coalesce(F.array_max(F.filter(places, lambda i: (i <= F.length(a)) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))), F.lit(0))


def literals(docs: DataFrame, doc_id: str, needles: DataFrame, name: str) -> DataFrame:
    """doc_id, name, hits: occurrences without overlap of each rule's literal. Rules are few (a policy file) and sized by the caller."""
    rules = needles.groupBy().agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col("needle").alias("needle"))).alias("rules"))
    d = docs.select(F.col(doc_id).alias("doc_id"), "text").join(F.broadcast(rules))
    own = F.filter("rules", lambda r: F.col("text").contains(r["needle"]))
    d = d.select("doc_id", "text", F.explode(own).alias("r"))
    hits = (F.length("text") - F.length(F.replace(F.col("text"), F.col("r.needle"), F.lit("")))) / F.length("r.needle")
    return d.select("doc_id", F.col("r.name").alias(name), hits.cast("long").alias("hits"))


def most_specific(rules: DataFrame, path: str) -> DataFrame:
    """Rules without a matched rule below them: each path's ancestors are listed, so it is an equi-join, not a prefix scan."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = rules.select(F.explode(up).alias("_above")).distinct()
    return rules.join(above, F.col(path) == F.col("_above"), "left_anti")


_CJK = "一-鿿㐀-䶿぀-ヿ가-힯"


#: So many distinct words of a corpus are broadcast; more are joined by shuffle.
WORDS = 200_000
#: Runs of what is no letter of another script: characters by range come first, and only others are asked for their kind.
_OWN = f"(?s)\\A[\\x00-©«-´¶-¹»-ɏ{_CJK}\\P{{IsAlphabetic}}]*+."


def _profile(rows: DataFrame) -> DataFrame:
    """key (the text's digest), tokens (CJK characters, words of Latin letters and digits), other (whether another script occurs)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    ascii = F.octet_length(t) == F.length(t)
    tokens = F.array_distinct(F.regexp_extract_all(F.when(ascii, F.lower(t)).otherwise(T.ascii_lower(t)), F.lit(f"([{_CJK}]|[0-9a-zÀ-ɏ]+)"), 0))
    return rows.withColumn("key", F.md5(t.cast("binary"))).withColumn("tokens", tokens).withColumn("other", ~ascii & t.rlike(_OWN))


def item_prefilter(docs: DataFrame, doc_id: str, items: DataFrame) -> DataFrame:
    """doc_id, skipped: whether no item of the corpus needs a scan of the document.

    An item may be skipped if both sides have tokens and no other script, and they share no token, or none of 4 characters
    and less than half of either side. A token of 4 characters is looked up in the words of all items; documents without
    one count their shared short tokens by item."""
    i = _profile(items.select("text")).select("key", "tokens", "other").dropDuplicates(["key"])
    always = F.col("other") | (F.size("tokens") == 0)
    every = i.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.bool_or(always), F.lit(False)).alias("open"))
    held = i.where(~always).select(F.col("key").alias("item"), F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    known = held.where(F.length("token") >= 4).select("token", F.lit(True).alias("hit")).distinct()
    known = F.broadcast(known) if known.count() <= WORDS else known
    # Texts are read for tokens once. Each gives a row for a long token and one with all the short ones, whose own token (with a
    # space) meets nothing; of the rows that met a word, one a text is left before anything is shuffled.
    w = _profile(docs.select("text")).select("key", "tokens", always.alias("always"))
    long = F.transform(F.filter("tokens", lambda x: ~F.col("always") & (F.length(x) >= 4)), lambda x: F.struct(x.alias("token"), F.lit(None).cast("array<string>").alias("short")))
    rest = F.struct(F.concat(F.lit(" "), F.col("key")).alias("token"), F.filter("tokens", lambda x: F.length(x) < 4).alias("short"))
    w = w.select("key", "always", F.size("tokens").alias("n"), F.explode_outer(F.concat(long, F.array(rest))).alias("w"))  # outer: else tokens are found once more to drop empty arrays
    w = w.select("key", "always", "n", "w.*").join(known, "token", "left").where("hit or short is not null").groupBy("key", "always", "n", "short").agg(F.bool_or("hit").alias("hit"))
    # Decisions depend on texts alone, so copies are decided once. A decided text goes on with a token that meets nothing.
    w = w.groupBy("key").agg(F.max("n").alias("n"), (F.bool_or("always") | F.coalesce(F.bool_or("hit"), F.lit(False))).alias("scan"), F.max("short").alias("short"))
    w = w.select("key", "n", "scan", F.explode_outer(F.when(F.col("scan") | (F.size("short") == 0), F.array(F.concat(F.lit(" "), F.col("key")))).otherwise(F.col("short"))).alias("token"))
    both = w.join(held.where(F.length("token") < 4), "token", "left").groupBy("key", "scan", "n", "item", "m").agg(F.count(F.lit(1)).alias("both"))
    scan = both.groupBy("key").agg(F.bool_or(F.col("scan") | (F.col("item").isNotNull() & (F.col("both") * 2 >= F.least("n", "m")))).alias("scan"))
    got = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("key")).join(scan, "key").join(F.broadcast(every))
    return got.select("doc_id", (~((F.col("items") > 0) & (F.col("open") | F.col("scan")))).alias("skipped"))


def chunks(docs: DataFrame, doc_id: str, size: int = 8192, overlap: int = 64) -> DataFrame:
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / step)).cast("int")
    d = docs.select(F.col(doc_id).alias("doc_id"), "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return d.select("doc_id", F.col("k").cast("long").alias("chunk"), F.substring(F.col("text"), F.col("k") * step + 1, F.lit(size)).alias("part"))


def manifest_split(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, state: 'same' where path and size are as before, else 'new'; only new files are indexed again."""
    keys = now.columns
    mark = before.select(*keys, F.lit(True).alias("_same"))
    return now.join(mark, keys, "left").select(keys[0], F.when(F.col("_same"), "same").otherwise("new").alias("state"))
