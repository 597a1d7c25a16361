"""Language identification by a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

Texts are cut into windows of WINDOW bytes; in each, a forward and a backward GRU read the bytes and every position gets
a distribution over the learned languages. A document's distribution is the mean over all its positions, so whole texts
are read in bounded memory. The model is a few kilobytes of arrays, broadcast to the workers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import append, crc_mod, hash_fraction, table

WINDOW = 64
HIDDEN = 10
#: Bounds of the training: labelled windows a language (of all windows of whole texts), and batches.
SAMPLE_WINDOWS, STEPS = 2400, 250
ROWS = 4096


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the squashing function of this network, several times cheaper than tanh. Its slope is (1 - |y|)^2."""
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=x)


class ByteGru:
    """Arrays by side (f, b): E (3H, 256) byte to gate and candidate inputs; U (3H, H) recurrent; c (H) inside the reset product. O (K, 2H), o (K)."""

    def __init__(self, langs: list[str], seed: int = 7):
        self.langs = langs
        r = np.random.default_rng(seed)
        h, f = HIDDEN, np.float32
        self.p = {}
        for s in "fb":
            self.p |= {f"E{s}": r.normal(0, 0.5, (3 * h, 256)).astype(f), f"U{s}": r.normal(0, h**-0.5, (3 * h, h)).astype(f), f"c{s}": np.zeros((h, 1), f)}
        self.p |= {"O": r.normal(0, 0.3, (len(langs), 2 * h)).astype(f), "o": np.zeros((len(langs), 1), f)}

    def _run(self, x: np.ndarray, s: str, keep: bool = False):
        """x (T, B) bytes. The states (T, H, B), in the order of the text; keep: what the backward pass needs."""
        h, (t, b) = HIDDEN, x.shape
        e, u, c = self.p[f"E{s}"], self.p[f"U{s}"], self.p[f"c{s}"]
        out, state, kept = np.empty((t, h, b), np.float32), np.zeros((h, b), np.float32), []
        given, back = np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32)
        for k in range(t) if s == "f" else range(t - 1, -1, -1):
            np.take(e, x[k], axis=1, out=given, mode="clip")
            np.matmul(u, state, out=back)
            zr = given[: 2 * h] + back[: 2 * h]
            zr = _soft(zr)
            zr += 1
            zr *= 0.5
            hv = back[2 * h :] + c
            n = zr[h:] * hv
            n += given[2 * h :]
            n = _soft(n)
            new = state - n
            new *= zr[:h]
            new += n
            if keep:
                kept.append((k, state, zr, hv, n))
            out[k] = state = new
        return out, kept

    def _outputs(self, x: np.ndarray, keep: bool = False):
        runs = {s: self._run(x, s, keep) for s in "fb"}
        h = HIDDEN
        y = np.matmul(self.p["O"][:, :h], runs["f"][0])
        y += np.matmul(self.p["O"][:, h:], runs["b"][0])
        y += self.p["o"]
        np.exp(np.clip(y, -60, 60, out=y), out=y)  # states are within 1, so logits stay small
        y /= y.sum(axis=1, keepdims=True)
        return y, runs

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, K, B) of each language at each position."""
        return self._outputs(x)[0]

    def gradients(self, x: np.ndarray, want: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over unmasked positions and its gradients, by backpropagation through time. x, mask (T, B); want (B)."""
        h, (t, b) = HIDDEN, x.shape
        y, runs = self._outputs(x, keep=True)
        n_all, own = mask.sum(), np.arange(b)
        loss = float(-(np.log(y[:, want, own] + 1e-9) * mask).sum() / n_all)
        y[:, want, own] -= 1
        y *= (mask / n_all)[:, None, :]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = y.sum((0, 2))[:, None]
        for s, cols in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            states = runs[s][0]
            g["O"][:, cols] = np.einsum("tkb,thb->kh", y, states)
            up = np.matmul(self.p["O"][:, cols].T, y)
            u = self.p[f"U{s}"]
            carry = np.zeros((h, b), np.float32)
            back = np.empty((3 * h, b), np.float32)
            at_input = np.empty((t, 3 * h, b), np.float32)
            for k, before, zr, hv, n in reversed(runs[s][1]):
                d = up[k] + carry
                z, r = zr[:h], zr[h:]
                dn = d * (1 - z) * (1 - np.abs(n)) ** 2
                slope = 0.5 * (1 - np.abs(2 * zr - 1)) ** 2
                back[:h] = d * (before - n) * slope[:h]
                back[h : 2 * h] = dn * hv * slope[h:]
                back[2 * h :] = dn * r
                carry = d * z + u.T @ back
                g[f"U{s}"] += back @ before.T
                g[f"c{s}"] += back[2 * h :].sum(1, keepdims=True)
                at_input[k, : 2 * h], at_input[k, 2 * h :] = back[: 2 * h], dn
            flat = x.reshape(-1)
            for j in range(3 * h):
                g[f"E{s}"][j] = np.bincount(flat, at_input[:, j].reshape(-1), minlength=256)
        return loss, g

    def fit(self, windows: list[bytes], langs: list[int], steps: int = STEPS, rate: float = 0.02, batch: int = 192) -> list[float]:
        """Adam over `steps` shuffled batches, in as many rounds through the sample as they take; returns each batch's loss."""
        x, mask = _grid(windows)
        want, r = np.array(langs), np.random.default_rng(11)
        m, v, k, losses = {n: 0.0 for n in self.p}, {n: 0.0 for n in self.p}, 0, []
        order = np.zeros(0, np.int64)
        while k < steps:
            if not len(order):
                order = r.permutation(x.shape[1])
            own, order = order[:batch], order[batch:]
            loss, g = self.gradients(x[:, own], want[own], mask[:, own])
            losses.append(loss)
            step = rate * 0.5 ** max(0.0, 5 * k / steps - 2)
            k += 1
            size = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            for n, q in g.items():
                q = q * min(1.0, 1.0 / (size + 1e-9))
                m[n] = 0.9 * m[n] + 0.1 * q
                v[n] = 0.99 * v[n] + 0.01 * q * q
                self.p[n] -= (step * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Each text's distribution (n, K): the mean over its positions. Windows of many texts go through the network together."""
        sums = np.zeros((len(texts), len(self.langs)))
        owners: list[int] = []
        windows: list[bytes] = []

        def flush() -> None:
            x, mask = _grid(windows)
            y = self.positions(x)
            y *= mask[:, None, :]
            np.add.at(sums, np.array(owners), y.sum(0).T)
            owners.clear()
            windows.clear()

        for k, text in enumerate(texts):
            for at in range(0, len(text), WINDOW):
                windows.append(text[at : at + WINDOW])
                owners.append(k)
                if len(windows) == ROWS:
                    flush()
        if windows:
            flush()
        return sums / np.maximum(1, np.array([len(x) for x in texts]))[:, None]


def _grid(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, n) bytes, short windows filled with zeros, and the mask of real ones."""
    x = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW).astype(np.intp)
    size = np.array([len(w) for w in windows])
    return np.ascontiguousarray(x.T), (np.arange(WINDOW)[:, None] < size[None, :]).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, windows_a_lang: int = SAMPLE_WINDOWS) -> ByteGru | None:
    """Learns from text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2.

    The labelled rows are the windows of whole texts; the sample is about `windows_a_lang` of each language (all, if fewer),
    fixed by doc_id and place: what reaches the driver has this bound. Documents are drawn first, 16 times as many as
    windows in proportion, then windows of these. None: nothing to learn from."""
    own = docs.select("doc_id", "lang", "text").where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    count = F.ceil(F.octet_length("text") / WINDOW).cast("int")
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.sum(count).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, windows_a_lang / n))])[F.col("lang")]
    own = own.withColumn("share", share).withColumn("drawn", F.least(F.lit(1.0), 16 * share)).where(hash_fraction(F.col("doc_id"), 9) < F.col("drawn"))
    taken = F.filter(F.sequence(F.lit(0), count - 1), lambda k: hash_fraction(F.xxhash64("doc_id", k), 3) < F.col("share") / F.col("drawn"))
    own = own.withColumn("taken", taken).where(F.size("taken") > 0).withColumn("raw", F.encode("text", "utf-8"))
    rows = own.select("doc_id", "lang", F.transform("taken", lambda k: F.substring(F.col("raw"), k * WINDOW + 1, F.lit(WINDOW))).alias("cuts")).collect()
    langs = sorted({r.lang for r in rows})
    pairs = sorted({(r.doc_id, bytes(w), langs.index(r.lang)) for r in rows for w in r.cuts if has_letter(bytes(w).decode(errors="ignore"))})
    if not pairs:
        return None
    model = ByteGru(langs)
    model.fit([p[1] for p in pairs], [p[2] for p in pairs])
    return model


def predict(docs: DataFrame, model: ByteGru | None, text: str = "text") -> DataFrame:
    """All columns of `docs`, then lang_pred and lang_score (see `append` on names). Null texts and texts without a letter: 'und', 0; so for all if there is no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def score(texts: list) -> list:
            known = [has_letter(t) and m is not None for t in texts]
            p = m.documents([t.encode() if k else b"" for t, k in zip(texts, known)]) if any(known) else None
            best = p.argmax(1) if p is not None else []
            return [[m.langs[best[i]] if k else "und" for i, k in enumerate(known)], [min(1.0, float(p[i, best[i]])) if k else 0.0 for i, k in enumerate(known)]]

        return score

    return append(docs, text, "lang_pred string, lang_score double", make)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; null doc_ids are not held out and not learned from. Empty table: no rows."""
    docs = table(spark, sf_dir, "documents")
    got = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs))
    return got.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
