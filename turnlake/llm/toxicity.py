"""Toxicity by weak supervision.

Voters look at a document's set of lower-case words: each lexicon voter knows one word, each pattern voter one word
beginning (4 or 5 letters); they vote toxic where they fire and abstain elsewhere. Three more vote clean or toxic: a short
general lexicon, insults in spellings with digits and marks, and one that votes clean where no other fires. Lexicon and
pattern voters are proposed from the labelled sample: words and beginnings that toxic documents hold far more often.

The label model is generative: a class prior and, for each voter, the rate of firing in either class, fitted by EM to the
votes alone. Voters that fire together more than their classes explain are correlated; a voter's evidence is divided by
one plus its squared partial correlations with all others, so a group of near-copies counts about once. Its posteriors are
the soft labels of a linear classifier on hashed word and beginning features (logistic, L1), which scores whole texts."""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import Memo, append, crc_mod, labelled_sample, table

BITS = 20
#: Bound of the labelled sample; voters at most; a proposed voter's least documents and least log-odds.
SAMPLE_ROWS, VOTERS, LEAST_DOCS, LEAST_ODDS = 4000, 300, 4, 4.0
# General insults that hold whatever the sample shows.
GENERAL = frozenset("idiot idiots moron morons loser losers scum stupid pathetic worthless trash disgusting imbecile bastard retard whore".split())
# Digits and marks that stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W\d_]+")
_MARKED = re.compile(r"\w*[0-9@$!]\w+")


def words(text: str) -> set[str]:
    return set(map(sys.intern, _WORD.findall(text.lower())))  # one copy of a word for all documents


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in (4, 5) if len(word) > n]


def _place(feature: str) -> int:
    return zlib.crc32(feature.encode()) >> (32 - BITS)


def word_features(ws: set[str]) -> set[str]:
    return ws | {w[:4] + "*" for w in ws if len(w) > 4} | {w[:5] + "*" for w in ws if len(w) > 5}


def propose(sample: list[tuple[set[str], int]]) -> list[str]:
    """Words and beginnings ('abcd*') whose document counts set the toxic apart, best first, at most VOTERS."""
    toxic, clean, n = Counter(), Counter(), [0, 0]
    for ws, y in sample:
        n[y] += 1
        (toxic if y else clean).update(word_features(ws))
    found = []
    for f, t in toxic.items():
        odds = np.log((t + 0.5) / (n[1] + 1)) - np.log((clean[f] + 0.5) / (n[0] + 1))
        if t >= LEAST_DOCS and odds >= LEAST_ODDS:
            found.append((-odds * t**0.5, f))
    return [f for _, f in sorted(found)[:VOTERS]]


class Voters:
    def __init__(self, proposed: list[str]):
        self.proposed = {f: k for k, f in enumerate(proposed)}
        self.size = len(proposed) + 3

    def votes(self, text: str, ws: set[str]) -> np.ndarray:
        """1 fires, 0 abstains, in the order: proposed, general lexicon, disguised spelling, 'no other fires'."""
        v = np.zeros(self.size, np.float32)
        for f in self.proposed.keys() & word_features(ws):
            v[self.proposed[f]] = 1
        v[-3] = not ws.isdisjoint(GENERAL)
        v[-2] = any(m.lower().translate(LEET) in GENERAL for m in _MARKED.findall(text))
        v[-1] = not v[:-1].any()
        return v


class LabelModel:
    """prior, fire (2, V): the class share and each voter's firing rates; weight (V): one over its share of correlated copies."""

    def fit(self, votes: np.ndarray, rounds: int = 40) -> np.ndarray:
        """Posterior of class 1 for each row; EM starts from 'any voter but the last fired'."""
        q = np.clip(1 - votes[:, -1], 0.05, 0.95)
        self.weight = np.ones(votes.shape[1])
        for k in range(rounds):
            self.prior = float(np.clip(q.mean(), 0.01, 0.99))
            self.fire = np.stack([((1 - q) @ votes + 0.1) / ((1 - q).sum() + 1), (q @ votes + 0.1) / (q.sum() + 1)])
            if k % 10 == 9:
                self._correlate(votes, q)
            q = self.posterior(votes)
        return q

    def _correlate(self, votes: np.ndarray, q: np.ndarray) -> None:
        total = np.zeros((votes.shape[1],) * 2)
        for c, share in ((0, 1 - q), (1, q)):
            d = (votes - self.fire[c]) * np.sqrt(share)[:, None]
            total += d.T @ d
        s = np.sqrt(np.maximum(np.diag(total), 1e-9))
        rho = total / s[:, None] / s[None, :]
        np.fill_diagonal(rho, 0)
        self.correlation = rho
        self.weight = 1 / (1 + (np.where(np.abs(rho) > 0.2, rho, 0) ** 2).sum(1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on, off = np.log(self.fire[1] / self.fire[0]), np.log((1 - self.fire[1]) / (1 - self.fire[0]))
        x = np.log(self.prior / (1 - self.prior)) + votes @ (on * self.weight) + (1 - votes) @ (off * self.weight)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Classifier:
    """Logistic regression on the presence of hashed words and beginnings; sparse weights and a bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.bias = bias
        self.table = weights
        self._memo: Memo | None = None

    def __getstate__(self):
        return {"bias": self.bias, "table": self.table, "_memo": None}

    def _word(self, word: str) -> tuple:
        return tuple((p, self.table[p]) for p in map(_place, (word, *beginnings(word))) if p in self.table)

    def score(self, text: str) -> float:
        if self._memo is None:
            self._memo = Memo(self._chunk, 400_000)
        hit = {p: w for own in map(self._memo.__getitem__, set(text.split())) if own for p, w in own}
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(hit.values()), -35, 35))))

    def _chunk(self, chunk: str) -> tuple:
        if chunk.isalpha():
            return self._word(chunk.lower())
        found = [x for w in _WORD.findall(chunk.lower()) for x in self._word(w)]
        for m in _MARKED.findall(chunk):
            found += self._word(m.lower().translate(LEET))
        return tuple(found)


def fit(rows: list[tuple[str, int]], passes: int = 30) -> tuple[Classifier, LabelModel | None]:
    """No rows or one class only: a classifier of the class share. Labels propose voters; the soft labels come from the label model."""
    sample = [(words(t), int(bool(y))) for t, y in rows]
    share = sum(y for _, y in sample) / max(1, len(sample))
    if not rows or share in (0.0, 1.0):
        p = min(0.95, max(0.05, share)) if rows else 0.05
        return Classifier({_place(w): 8.0 for w in GENERAL}, float(np.log(p / (1 - p)))), None
    voters = Voters(propose(sample))
    votes = np.stack([voters.votes(t, ws) for (t, _), (ws, _) in zip(rows, sample)])
    model = LabelModel()
    soft = model.fit(votes)
    # Features that few documents hold can't be told from chance; document counts need no labels.
    places = [np.unique(np.fromiter(map(_place, word_features(ws)), np.int32)) for ws, _ in sample]
    counts = np.bincount(np.concatenate(places), minlength=1 << BITS)
    kept = np.flatnonzero(counts >= LEAST_DOCS)
    column = np.full(1 << BITS, -1)
    column[kept] = np.arange(len(kept))
    rows_at = [column[own][column[own] >= 0] for own in places]
    flat = np.concatenate(rows_at) if rows_at else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows_at)), [len(r) for r in rows_at])
    # Proximal gradient steps (L1), each feature's rate by its own document count.
    w, b = np.zeros(len(kept)), float(np.log(soft.mean() / (1 - soft.mean())))
    size = np.bincount(flat, minlength=len(kept)) + 1.0
    evidence = np.bincount(flat, soft[owner] - soft.mean(), minlength=len(kept)) / np.sqrt(size)
    strong = np.abs(evidence) > 1.5
    owner, flat = owner[strong[flat]], flat[strong[flat]]
    for _ in range(passes * 10):
        x = b + np.bincount(owner, w[flat], minlength=len(rows_at))
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        g = np.bincount(flat, (p - soft)[owner], minlength=len(kept))
        w -= 2.0 * g / size
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.6 / size)
        b -= 2.0 * float((p - soft).mean())
    weights = {int(kept[k]): float(w[k]) for k in np.flatnonzero(w)}
    return Classifier(weights, b), model


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """All columns of `docs`, then toxic_score (see `append` on names); null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, text, "toxic_score double", lambda: lambda texts: [[shared.value.score(t or "") for t in texts]])


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    return fit(labelled_sample(docs, labels, "toxic", SAMPLE_ROWS, 5))[0]


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from at most about SAMPLE_ROWS labelled rows that aren't held out; null doc_ids are neither. Empty table: no rows."""
    docs = table(spark, sf_dir, "documents")
    got = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
