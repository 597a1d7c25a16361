"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters or digits and runs of marks; a word in capitals also gives a shape token. Single tokens and
neighbouring pairs (a token twice in a row is one feature, whatever the token) are hashed to 2^BITS places; a feature's value is its share of the document's n-grams, times SCALE. A
score is the sparse dot product of these values with the weights, through the logistic function."""

from __future__ import annotations

import re
import struct
import zlib
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import Memo, append, crc_mod, labelled_sample, table

BITS = 18
SCALE = 30.0
#: Bound of the labelled sample that is fitted on the driver, and passes over it.
SAMPLE_ROWS, PASSES = 4000, 2
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def _chunk_tokens(chunk: str) -> bytes:
    """32-bit hashes of a white-space-free chunk's tokens, packed."""
    out = []
    for t in _TOKENS.findall(chunk):
        if len(t) > 1 and t.isupper():
            out.append(zlib.crc32(b"\0caps"))
        out.append(zlib.crc32(t.lower().encode()))
    return struct.pack(f"<{len(out)}I", *out)


_chunks = Memo(_chunk_tokens, 400_000)


def features(text: str) -> np.ndarray:
    """Places of every single token and pair of the text (with repeats); an empty text has none."""
    one = np.frombuffer(b"".join(map(_chunks.__getitem__, text.split())), "<u4").astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    two = np.where(one[:-1] == one[1:], np.uint64(7), one[:-1] * mix + one[1:] + np.uint64(1))  # any token twice is one feature
    both = np.concatenate([one * mix, two * mix])
    return (both >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-Proximal: per-coordinate rates, L1 and L2; weights follow from z and n."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z, self.bias_n = 0.0, 0.0

    def _solve(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w, b = self._solve(self.z[at], self.n[at]), self.bias()
        g0 = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35))) - label
        g = g0 * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g
        s0 = ((self.bias_n + g0 * g0) ** 0.5 - self.bias_n**0.5) / self.alpha
        self.bias_z += g0 - s0 * b
        self.bias_n += g0 * g0

    def weights(self) -> np.ndarray:
        return self._solve(self.z, self.n).astype(np.float32)


def fit(rows: list[tuple[str, int]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias. No rows: all zero, so every score is 0.5."""
    model = Ftrl()
    held = []
    for text, label in rows:
        at, count = np.unique(features(text), return_counts=True)
        held.append((at, count / max(1, count.sum()) * SCALE, label))
    r = np.random.default_rng(5)
    for _ in range(passes):
        for k in r.permutation(len(held)):
            model.update(*held[k])
    return model.weights(), model.bias()


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text") -> DataFrame:
    """All columns of `docs` and quality_score; null texts score as empty ones: by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, float(bias)))

    def make():
        w, b = shared.value

        def one(text: str | None) -> float:
            at = features(text or "")
            return float(1 / (1 + np.exp(-np.clip(b + (w[at].mean(dtype=np.float64) * SCALE if len(at) else 0.0), -35, 35))))

        return lambda texts: [[one(t) for t in texts]]

    return append(docs, text, "quality_score double", make)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from at most about SAMPLE_ROWS labelled rows that aren't held out; null doc_ids are neither. Empty table: no rows."""
    docs = table(spark, sf_dir, "documents")
    got = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), *fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", SAMPLE_ROWS, 9)))
    return got.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
