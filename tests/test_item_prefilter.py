"""The prefilter over all items against brute force over all pairs."""

from test_triggers import shuffled

from turnlake.operators import leakscan

CJK = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x30FF), (0xAC00, 0xD7AF)]


def profile(text):
    tokens, other, word = set(), False, ""
    for c in (text or "") + " ":
        cjk = any(a <= ord(c) <= b for a, b in CJK)
        if not cjk and (c.isascii() and c.isalnum() or 0xC0 <= ord(c) <= 0x24F):
            word += c.lower() if c.isascii() else c
            continue
        tokens |= {word} if word else set()
        word = ""
        if cjk:
            tokens.add(c)
        elif c.isalpha():
            other = True
    return tokens, other


def skip(a, b):
    (s, other), (t, foreign) = a, b
    if other or foreign or not s or not t:
        return False
    both = s & t
    return not both or not (any(len(x) >= 4 for x in both) or 2 * len(both) >= min(len(s), len(t)))


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r.skipped for r in leakscan.item_prefilter(d, "doc_id", i).collect()}
    held = [profile(t) for t in items]
    assert got == {k: all(skip(profile(t), h) for h in held) for k, t in docs}
    return got


def test_odd_texts(spark):
    items = ["Alpha beta gamma of it", "one two a b c d e f", "秘密 passage 文", "Élan vital x1 y2 z3"]
    docs = [(1, "no such thing"), (2, "ALPHA"), (3, "a b c zz yy"), (4, "a zz yy xx ww vv uu tt"), (5, "весь текст"), (6, "文 zz yy"), (7, ""), (8, None), (9, "!!"), (10, "élan"), (11, "x1 y2"), (None, "gamma"), (12, "文 q w e r t y u i")]
    got = check(spark, docs, items)
    assert got[1] and got[4] and not got[5] and not got[7] and not got[2]
    assert not any(check(spark, docs, [*items, "текст"]).values())
    assert all(check(spark, docs, []).values())


def test_given_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])


def test_other_scripts(spark):
    """The search for other scripts' letters finds the characters of the plain class, alone and behind others."""
    chars = [(chr(c),) for c in [*range(0x3200), *range(0x9F00, 0xA100), *range(0xD700, 0xD800), *range(0x1D400, 0x1D500), *range(0x1F600, 0x1F650)]]
    texts = spark.createDataFrame([*chars, *[(f"a—é文 {c} z",) for (c,) in chars[:0x400]]], "text string")
    plain = f"[\\p{{IsAlphabetic}}&&[^A-Za-zÀ-ɏ{leakscan._CJK}]]"
    got = leakscan._profile(texts).select("text", "other", texts.text.rlike(plain).alias("want"))
    assert got.where("other <> want").count() == 0 and got.where("other").count() > 1000


def test_rows_shuffled(spark):
    """Words aren't shuffled: a few rows a document are, however many words it has."""
    n, m = 200, 300
    docs = spark.createDataFrame([(k, " ".join(f"word{k * m + w}" for w in range(m))) for k in range(n)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word1 word2"), (2, "it is")], "item_id long, text string")
    df = leakscan.item_prefilter(docs, "doc_id", items)
    assert sorted(r.doc_id for r in df.collect() if not r.skipped) == [0]
    assert shuffled(df._jdf.queryExecution().executedPlan()) < n * m / 10


def test_many_words(spark, monkeypatch):
    """A corpus of more words than are broadcast gives the same."""
    monkeypatch.setattr(leakscan, "WORDS", 0)
    test_odd_texts(spark)
