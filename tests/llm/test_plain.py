"""The learned operators against plain loops over bytes, words and features."""

import math
import random
import zlib
from itertools import groupby

import numpy as np
import pytest

from turnlake.llm import language_id, quality, toxicity


def soft(x):
    return x / (1 + abs(x))


def read_bytes(p, side, window):
    """States of one side, one byte and one unit at a time."""
    h = language_id.HIDDEN
    e, u, c = p[f"E{side}"].tolist(), p[f"U{side}"].tolist(), p[f"c{side}"][:, 0].tolist()
    state, out = [0.0] * h, {}
    for k in range(len(window)) if side == "f" else reversed(range(len(window))):
        back = [sum(a * b for a, b in zip(row, state)) for row in u]
        gate = [(soft(e[j][window[k]] + back[j]) + 1) / 2 for j in range(2 * h)]
        n = [soft(e[2 * h + j][window[k]] + gate[h + j] * (back[2 * h + j] + c[j])) for j in range(h)]
        state = [gate[j] * state[j] + (1 - gate[j]) * n[j] for j in range(h)]
        out[k] = state
    return out


def plain_language(model, text):
    raw = text.encode()
    total = [0.0] * len(model.langs)
    for at in range(0, len(raw), language_id.WINDOW):
        own = raw[at : at + language_id.WINDOW]
        padded = own.ljust(language_id.WINDOW, b"\0")
        f, b = read_bytes(model.p, "f", padded), read_bytes(model.p, "b", padded)
        for k in range(len(own)):
            y = [math.exp(sum(w * s for w, s in zip(row, f[k] + b[k])) + o) for row, o in zip(model.p["O"].tolist(), model.p["o"][:, 0].tolist())]
            total = [t + v / sum(y) for t, v in zip(total, y)]
    return [t / len(raw) for t in total]


def test_language_network(spark, odd_docs):
    """Scores of whole texts: several windows, a short last one, characters of many bytes."""
    model = language_id.ByteGru(["de", "en", "fr"], seed=3)
    got = language_id.predict(odd_docs.select("text"), model).collect()
    assert len(got) == 10
    for text in {r.text for r in got}:
        rows = {(r.lang_pred, round(r.lang_score, 9)) for r in got if r.text == text}
        assert len(rows) == 1
        lang, score = rows.pop()
        if not any(map(str.isalpha, text or "")):
            assert (lang, score) == ("und", 0.0)
            continue
        want = plain_language(model, text)
        assert lang == model.langs[max(range(3), key=want.__getitem__)] and score == pytest.approx(max(want), abs=1e-4)


def kind(ch):
    return "_" if ch == "_" else "word" if ch.isalnum() else "mark"


def plain_features(text):
    """Place to share of the document's n-grams."""
    tokens = []
    for chunk in text.split():
        for k, run in groupby(chunk, kind):
            t = "".join(run)
            tokens += [zlib.crc32(b"\0caps")] * (len(t) > 1 and t.isupper()) + [zlib.crc32(t.lower().encode())]
    mix, low = 0x9E3779B97F4A7C15, (1 << 64) - 1
    grams = tokens + [7 if a == b else (a * mix + b + 1) & low for a, b in zip(tokens, tokens[1:])]
    places = [(g * mix & low) >> (64 - quality.BITS) for g in grams]
    return {p: places.count(p) / len(places) * quality.SCALE for p in set(places)}


def logistic(x):
    return 1 / (1 + math.exp(-max(-35, min(35, x))))


def plain_ftrl(rows, alpha=0.3, beta=1.0, l1=0.05, l2=0.5):
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(p):
        if abs(z.get(p, 0.0)) <= l1:
            return 0.0
        return -(z[p] - math.copysign(l1, z[p])) / ((beta + math.sqrt(n[p])) / alpha + l2)

    held, r = [(plain_features(t), y) for t, y in rows], np.random.default_rng(5)
    for _ in range(quality.PASSES):
        for k in r.permutation(len(held)):
            x, y = held[k]
            bias = -bz / ((beta + math.sqrt(bn)) / alpha)
            w = {p: weight(p) for p in x}
            miss = logistic(sum(w[p] * v for p, v in x.items()) + bias) - y
            for p, v in x.items():
                g = miss * v
                before = n.get(p, 0.0)
                z[p] = z.get(p, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[p]
                n[p] = before + g * g
            s = (math.sqrt(bn + miss * miss) - math.sqrt(bn)) / alpha
            bz, bn = bz + miss - s * bias, bn + miss * miss
    return {p: weight(p) for p in z}, -bz / ((beta + math.sqrt(bn)) / alpha)


def labelled(n, seed):
    """Texts of common words; those with label 1 also hold some of a few marked words."""
    r = random.Random(seed)
    common = "alpha beta gamma delta river stone GREEN under 42 a_b end. yes! yes!".split()
    marked = "zorkish zorkest blumpy gr0nk".split()
    out = []
    for k in range(n):
        y = int(k % 3 == 0)
        out.append((" ".join(r.choices(common, k=r.randint(3, 15)) + y * r.sample(marked, r.randint(1, 3))), y))
    return out


def test_quality_training_and_scores(spark, odd_docs):
    rows = labelled(90, 1) + [("", 0)]
    weights, bias = quality.fit(rows)
    want, want_bias = plain_ftrl(rows)
    assert bias == pytest.approx(want_bias, abs=1e-9) and any(want.values())
    assert {int(p): pytest.approx(float(weights[p]), abs=1e-5) for p in np.flatnonzero(weights)} == {p: w for p, w in want.items() if w}
    texts = [t for t, _ in labelled(20, 2)] + [r.text for r in odd_docs.collect()]
    got = quality.score(spark.createDataFrame([(t,) for t in texts], "text string"), weights, bias).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.quality_score == pytest.approx(logistic(want_bias + sum(want.get(p, 0.0) * v for p, v in plain_features(r.text or "").items())), abs=1e-5)


def plain_words(text):
    runs = ("".join(ch if ch.isalnum() and not ch.isdecimal() else " " for ch in text.lower())).split()
    return {f for w in runs for f in (w, *(w[:n] + "*" for n in (4, 5) if len(w) > n))}


def plain_toxicity(rows):
    """Proposals, votes, EM with correlations, and the classifier's steps, all by loops."""
    docs, n = [plain_words(t) for t, _ in rows], len(rows)
    place = lambda f: zlib.crc32(f.encode()) >> (32 - toxicity.BITS)
    ones = sum(y for _, y in rows)
    ranked = []
    for f in set().union(*docs):
        hit = [sum(f in d and y == c for d, (_, y) in zip(docs, rows)) for c in (0, 1)]
        odds = math.log((hit[1] + 0.5) / (ones + 1)) - math.log((hit[0] + 0.5) / (n - ones + 1))
        if hit[1] >= toxicity.LEAST_DOCS and odds >= toxicity.LEAST_ODDS:
            ranked.append((-odds * hit[1] ** 0.5, f))
    lexicon = [f for _, f in sorted(ranked)][: toxicity.VOTERS]
    votes = []
    for (text, _), d in zip(rows, docs):
        v = [f in d for f in lexicon] + [bool(d & toxicity.GENERAL)]
        v.append(any(m.lower().translate(toxicity.LEET) in toxicity.GENERAL for m in toxicity._MARKED.findall(text)))
        votes.append([float(x) for x in (*v, not any(v))])
    size = len(votes[0])
    q, weight = [min(0.95, max(0.05, 1 - v[-1])) for v in votes], [1.0] * size
    for k in range(40):
        prior = min(0.99, max(0.01, sum(q) / n))
        share = [[1 - x for x in q], q]
        fire = [[(sum(s * v[j] for s, v in zip(own, votes)) + 0.1) / (sum(own) + 1) for j in range(size)] for own in share]
        if k % 10 == 9:
            cov = [[sum(own[i] * (votes[i][a] - f[a]) * (votes[i][b] - f[b]) for own, f in zip(share, fire) for i in range(n)) for b in range(size)] for a in range(size)]
            s = [math.sqrt(max(cov[j][j], 1e-9)) for j in range(size)]
            rho = [[cov[a][b] / s[a] / s[b] if a != b else 0.0 for b in range(size)] for a in range(size)]
            weight = [1 / (1 + sum(x * x for x in row if abs(x) > 0.2)) for row in rho]
        q = []
        for v in votes:
            x = math.log(prior / (1 - prior))
            for j in range(size):
                x += weight[j] * (math.log(fire[1][j] / fire[0][j]) if v[j] else math.log((1 - fire[1][j]) / (1 - fire[0][j])))
            q.append(1 / (1 + math.exp(-max(-30, min(30, x)))))
    places = [{place(f) for f in d} for d in docs]
    count = {p: sum(p in d for d in places) for p in set().union(*places)}
    mean = sum(q) / n
    used = [p for p, c in count.items() if c >= toxicity.LEAST_DOCS and abs(sum(q[i] - mean for i in range(n) if p in places[i])) / math.sqrt(c + 1) > 1.5]
    w, b = dict.fromkeys(used, 0.0), math.log(mean / (1 - mean))
    for _ in range(300):
        miss = [logistic(b + sum(w[p] for p in d if p in w)) - x for d, x in zip(places, q)]
        for p in used:
            moved = w[p] - 2 * sum(m for m, d in zip(miss, places) if p in d) / (count[p] + 1)
            w[p] = math.copysign(max(0.0, abs(moved) - 0.6 / (count[p] + 1)), moved)
        b -= 2 * sum(miss) / n
    return q, w, b, place


def test_toxicity_training_and_scores(spark, odd_docs):
    rows = labelled(90, 3) + [("You 1d1ot and moron", 1), ("", 0)]
    model, _ = toxicity.fit(rows)
    _, want, bias, place = plain_toxicity(rows)
    assert model.bias == pytest.approx(bias, abs=1e-6) and any(want.values())
    assert {p: pytest.approx(w, abs=1e-6) for p, w in model.table.items()} == {p: w for p, w in want.items() if w}
    texts = [t for t, _ in labelled(20, 4)] + ["ZORKISH, zorkest! x-blumpy"] + [r.text for r in odd_docs.collect()]
    got = toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        held = {place(f) for f in plain_words(r.text or "")}
        assert r.toxic_score == pytest.approx(logistic(bias + sum(want.get(p, 0.0) for p in held)), abs=1e-6)


def test_label_model_posteriors():
    rows = labelled(60, 5)
    docs = [(toxicity.words(t), y) for t, y in rows]
    voters = toxicity.Voters(toxicity.propose(docs))
    got = toxicity.LabelModel().fit(np.stack([voters.votes(t, w) for (t, _), (w, _) in zip(rows, docs)]))
    assert got == pytest.approx(plain_toxicity(rows)[0], abs=1e-9)
