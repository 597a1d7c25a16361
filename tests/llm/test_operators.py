"""Each operator against a plain version, and on odd and empty tables."""

import hashlib
import io
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from turnlake.llm import fingerprints, jaccard, language_id, line_dedup, neighbours, packing, quality, sentencepieces, simhash, toxicity, warc


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def empty(df):
    return df.where("false")


def test_fingerprints(spark, odd_docs):
    got = fingerprints.fingerprint_edits(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[6][0].fingerprint == by[7][0].fingerprint and by[2][0].fingerprint == by[3][0].fingerprint
    assert by[7][0].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in got)
    # the row below the next one: descending ids, null last, then the first again
    texts = [(r.doc_id, r.text or "") for r in sorted(odd_docs.collect(), key=lambda r: -(r.doc_id if r.doc_id is not None else -1))]
    for (i, t), (_, n) in zip(texts, texts[1:] + texts[:1]):
        h = len(t) // 2
        assert hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest() in [r.edited_sha256 for r in by[i]]
    assert fingerprints.fingerprint_edits(empty(odd_docs)).count() == 0


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([(1, "b\na"), (2, "a\nb"), (3, "a"), (4, "b")], "k int, text string")
    p = {r.k: r for r in fingerprints.fingerprints(df, ["k"]).collect()}
    assert p[1].equal == p[2].equal and p[1].near == p[2].near
    assert [(x + y) % 2**32 for x, y in zip(p[3].equal, p[4].equal)] == p[1].equal


def test_gru_gradients():
    r, m = np.random.default_rng(0), language_id.ByteGru(["a", "b", "c"])
    x, want, mask = r.integers(0, 256, (10, 5)), r.integers(0, 3, 5), np.ones((10, 5), np.float32)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    g = m.gradients(x, want, mask)[1]
    for k, v in m.p.items():
        at = (0, x[3, 1]) if k[0] == "E" else (0, 0)
        kept = v[at]
        v[at] = kept + 1e-2
        up = m.gradients(x, want, mask)[0]
        v[at] = kept - 1e-2
        down = m.gradients(x, want, mask)[0]
        v[at] = kept
        assert abs((up - down) / 2e-2 - g[k][at]) < 1e-4


def test_language_id(spark, sf_dir, odd_docs):
    d = docs(spark, sf_dir)
    got = language_id.op2_language_id(spark, sf_dir).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.93 * len(got)
    odd = language_id.predict(odd_docs, language_id.train(odd_docs)).collect()
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id in (2, 3, 5, 9)} == {2: "und", 3: "und", 5: "und", 9: "und"} and len(odd) == 10
    assert language_id.train(empty(odd_docs)) is None and language_id.predict(empty(odd_docs), None).count() == 0


@pytest.fixture(scope="module")
def transducer():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return sentencepieces.PieceTransducer(f.read())


def test_sentencepieces(transducer, spark, sf_dir, odd_docs):
    import random

    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    texts = [t[0] for t in docs(spark, sf_dir).select("text").limit(40).collect()] + [" " * k + "the" for k in range(30)] + ["rrrrr", "▁a▁▁b", "<s> <0x0A>\x00", "\n\n x", "a" * 99]
    texts += ["".join(r.choice("abcdeth  \n.é日😀T=-0") for _ in range(r.randint(1, 50))) for _ in range(400)]
    for t in texts:
        packed = transducer.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == own.encode(t), t
        assert transducer.decode(packed) == t.replace("▁", " ")
    got = sentencepieces.encode_documents(odd_docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert all(r.round_trip for r in got) and all(r.n_pieces == 0 for r in got if r.doc_id in (2, 3))


def test_unigram_models_take_the_least_weight():
    import struct

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))

    model = piece("<unk>", 0, 2) + b"".join(piece(t, s, 1) for t, s in (("▁", -2.0), ("a", -2.0), ("b", -2.0), ("ab", -3.0), ("▁a", -1.0))) + field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00")
    t = sentencepieces.PieceTransducer(model)
    assert [t.pieces[i] for i in np.frombuffer(t.encode("ab"), "<u4")] == ["▁a", "b"]


def test_neighbours(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = neighbours.nearest(e).toPandas()
    p = e.toPandas()
    x, ids = np.array(p.embedding.tolist(), np.float64), p.vec_id.to_numpy()
    hits = 0
    queries = np.flatnonzero(ids % 20 == 0)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own.score) <= 0).all()
        hits += (own.score >= np.sort(s)[-20] - 1e-12).sum()
    assert hits >= 0.9 * 20 * len(queries)


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, None]), (None, [1.0, 1.0]), (4, []), (80, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 80, 0.5)] and {g[0] for g in got} == {0, 80}
    assert neighbours.nearest(df.where("false")).count() == 0


def test_label_model_weighs_copies_down():
    r = np.random.default_rng(2)
    y = r.random(3000) < 0.2
    a, b = (y & (r.random(3000) < 0.7)), (y & (r.random(3000) < 0.6)) | (r.random(3000) < 0.02)
    votes = np.stack([a, a, a, b, ~(a | b)], axis=1).astype(np.float32)
    m = toxicity.LabelModel()
    q = m.fit(votes)
    assert ((q > 0.5) == (a | b)).mean() > 0.95 and m.weight[0] < m.weight[3]


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_classifiers(spark, name, odd_docs):
    sf = "/root/testdata/sf0.01"
    query = toxicity.op5_toxicity if name == "toxic" else quality.op9_quality_classifier
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r[name] == r.predicted for r in got) >= 0.9 * len(got)
    rows = [("good plain words here", 1), ("you idiot moron", 0)] * 8
    odd = quality.score(odd_docs, *quality.fit(rows)) if name == "quality" else toxicity.score(odd_docs, toxicity.fit([(t, 1 - y) for t, y in rows])[0])
    assert odd.count() == 10 and odd.where(F.col(f"{name}_score").between(0, 1)).count() == 10
    assert quality.fit([])[1] == 0.0 and 0 < toxicity.fit([])[0].score("") < 0.5


def test_warc(spark, tmp_path):
    rows = [(1, "u", "x" * 1000), (2, "v\n", "x" * 1000), (5, "w", "x" * 1000), (6, "q", "ab"), (7, "q", "ab"), (8, None, None), (None, "n", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w"), f"file://{tmp_path}/w").collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None), None: ("response", None)}
    for k, _, html in rows:
        data = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha1(data).hexdigest()) and got[k].payload in (data, None)


def test_warc_faults():
    good = warc.record(1, "u", b"abc" * 500, None, False)
    assert [r[2] for r in warc.read_records(io.BytesIO(good * 3))] == [1500] * 3
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-5])))
    plain = zlib.decompress(good, 31).replace(b"abcabc", b"abcabd", 1)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(z.compress(plain) + z.flush())))


def test_packing(spark, odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(odd_docs, capacity=64).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 64
    want = []
    for r in odd_docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    key = lambda r: tuple(-1 if v is None or v != v else int(v) for v in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(map(key, want))
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1
    assert packing.pack_documents(empty(odd_docs)).count() == 0


def test_plan_uses_exact_complements():
    assert sorted(packing.plan({60: 2, 40: 1, 25: 1, 15: 1}, 100)) == [([60, 25, 15], 1), ([60, 40], 1)]
    used = {}
    counts = {1: 5000, 2048: 3, 700: 100, 1300: 77, 48: 60}
    for lengths, times in packing.plan(counts):
        assert sum(lengths) <= 2048
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts


def plain_simhash(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, sf_dir, odd_docs):
    for t in [r.text for r in docs(spark, sf_dir).limit(60).collect()] + [r.text for r in odd_docs.collect()]:
        assert simhash.simhash(t or "") == plain_simhash(t)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(odd_docs).collect()}
    assert got[7] == 6 and got[2] == got[3] == got[5] == 2 and got[8] == 8
    assert simhash.near_groups(empty(odd_docs)).count() == 0
    kept = jaccard.keep_one(odd_docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 6, 8, 9]


def test_links_over_chains_and_cut_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 7)
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 30, dtype=np.int64).astype(np.uint64)
    fps = set(base.tolist())
    for b in base[:6]:
        x = int(b)
        for _ in range(25):  # chains of one and two bits
            for k in r.choice(64, r.integers(1, 3), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    u = np.array(sorted(fps), np.uint64)
    root = list(range(len(u)))
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 2):
            a, b = root[i], root[int(j)]
            root = [min(a, b) if x in (a, b) else x for x in root]
    s = u.view(np.int64)
    want = {int(s[i]): min(int(s[j]) for j in range(len(u)) if root[j] == root[i]) for i in range(len(u))}
    d = spark.createDataFrame([(int(x),) for x in s], "fp long")
    got = {x.fp: x.label for x in simhash.components(simhash.links(d), len(u)).collect()}
    assert all(got.get(k, k) == v for k, v in want.items())


def test_line_dedup(spark, odd_docs):
    rows = [(k, f"Menu | home\nown line {k}\n\n Menu | home ", "h" if k < 20 else "small", 1) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lines_kept int")
    got = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    assert got[3].text == "own line 3\n" and got[3].lines_dropped == 2 and got[21].lines_dropped == 2
    odd = line_dedup.drop_lines(odd_docs, ratio=0.5).collect()
    assert len(odd) == 10 and [r.text for r in odd if r.doc_id == 2] == [None]
    assert line_dedup.drop_lines(empty(odd_docs)).count() == 0
