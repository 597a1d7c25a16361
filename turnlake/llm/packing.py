"""Best-fit packing of tokenised documents into sequences, with exact-complement hashing first.

Only a histogram of piece lengths (at most `capacity` numbers, whatever the corpus) reaches the driver, which plans
patterns: lengths that share a sequence, and how many sequences are made so. `plan` takes the longest length left, looks up
the gap it leaves in the index of single lengths, of pair sums and of triple sums, and uses an exact combination as often as
its lengths are still available; where there is none, the largest length that fits goes in (best fit) and the lookup is
repeated for the rest. Then each piece finds its place from its length and its rank among pieces of that length; ranks come
from windows over (length, salt), so a length that holds a third of all rows is dealt over many tasks."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.common import materialise, slices, small_batches, table, worker_table

CAPACITY = 2048
#: Rows of one length ranked by one task: a thousandth of all, at most a million.
SHARE, MOST = 1000, 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|-]*)")


class ChunkEncoder(dict):
    """Ids of a text as little-endian 32-bit numbers, by way of its white-space-free chunks, which are the keys.

    For tokenizers that turn white space into cuts, which `tokenizers` applies before pieces are merged: a text's ids are
    then its chunks' ids in a row. Letters and the punctuation after them are also cut by this tokenizer's pattern, so a
    capitalised or punctuated word follows from its parts, and a word of small Latin letters, which normalising and cutting leave
    as it is, goes to the merges at once, each letter as its byte symbols. At most LIMIT chunks are held, none beyond LONG characters, and
    chunks made of parts only in the first half; as with Memo, a full table is dropped after many misses."""

    LIMIT, LONG = 400_000, 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.own, self.missed = Tokenizer.from_file(path), 0
        # What Unicode calls white space, in the tokenizer's pattern; str.split() also splits at these four.
        self.odd = re.compile("[\x1c-\x1f]")
        self.model = self.own.model
        letters = [c for c in map(chr, range(97, 256)) if _LETTERS.fullmatch(c) and c.islower()]
        self.symbols = {ord(c): "".join(s for s, _ in self.own.pre_tokenizer.pre_tokenize_str(c)) for c in letters}
        self.direct = all(self._word(w) == self._ids(w) for w in ("tokenizer", "".join(letters)))

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.translate(self.symbols))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, text: str) -> bytes:
        ids = self.own.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        m = _LETTERS.fullmatch(chunk)
        if m and (m[2] or not chunk.islower()):
            ids, most = self[m[1].lower()] + (self[m[2]] if m[2] else b""), self.LIMIT // 2
        else:
            ids, most = self._word(chunk) if m and self.direct else self._ids(chunk), self.LIMIT
            self.missed += len(self) >= self.LIMIT
            if self.missed > 4 * self.LIMIT:
                self.missed = 0
                self.clear()
        if len(self) < most and len(chunk) <= self.LONG:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.odd.search(text):
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and `end_id`, cut into pieces of `capacity` ids.

    Null and empty texts are one piece with the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_table(tokenizer_path, lambda: ChunkEncoder(tokenizer_path)).encode
        end, step = struct.pack("<I", end_id), 4 * capacity
        for batch in slices(batches, tokenizer_path):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                rows += [(doc_id, k, at // 4, len(part := ids[at : at + step]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a sequence, times), using each length exactly as often as counted."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    patterns: list[tuple[list[int], int]] = []
    if left[capacity]:
        patterns.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    pair_sums, age = None, 0

    def free(n: int, taken: list[int]) -> bool:
        return left[n] > taken.count(n) if n in taken else left[n] > 0

    def pair(gap: int, taken: list[int], below: int) -> list[int] | None:
        half = gap // 2
        a = np.arange(min(gap - 1, below), (gap + 1) // 2 - 1, -1)
        if not len(a) or half < 1:
            return None
        for x in a[(left[a] > 0) & (left[gap - a] > 0)]:
            x = int(x)
            if free(x, taken) and free(gap - x, [*taken, x]):
                return [x, gap - x]
        return None

    def renew() -> None:
        nonlocal pair_sums, age
        there = (left > 0).astype(np.float64)
        pair_sums, age = np.rint(np.convolve(there, there))[: capacity + 1] > 0, 0

    def exact(gap: int, taken: list[int]) -> list[int] | None:
        nonlocal pair_sums, age
        if free(gap, taken):
            return [gap]
        if found := pair(gap, taken, capacity):
            return found
        if pair_sums is None or age > 64:  # stale sums are a superset, for lengths only run out
            renew()
        age += 1
        a = np.arange(gap - 2, max(0, (gap + 2) // 3 - 1), -1)
        a = a[(left[a] > 0) & pair_sums[gap - a]] if len(a) else a
        for k, x in enumerate(a):
            x = int(x)
            if k == 16 and age > 1:  # many false hits: the others are tried on sums of what is left
                renew()
            if pair_sums[gap - x] and free(x, taken) and (found := pair(gap - x, [*taken, x], x)):
                return [x, *found]
        return None

    for top in range(capacity - 1, 0, -1):
        while left[top]:
            taken = [top]
            gap = capacity - top
            while gap:
                if found := exact(gap, taken):
                    taken += found
                    break
                fits = np.flatnonzero(left[1 : gap + 1])[::-1] + 1
                best = next((int(x) for x in fits if free(int(x), taken)), None)
                if best is None:
                    break
                taken.append(best)
                gap -= best
            used = {n: taken.count(n) for n in set(taken)}
            times = min(int(left[n]) // k for n, k in used.items())
            for n, k in used.items():
                left[n] -= k * times
            patterns.append((taken, times))
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks (ascending), the sequence of each, and the offset there; rank r goes to sequence s + r - first."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            r = ranks.get(n, 0)
            found.setdefault(n, []).append((r, sequence, offset))
            ranks[n] = r + times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in found.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. `cut` is read twice, so give a written table. Empty: no rows."""
    spark = cut.sparkSession
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    total = sum(counts.values())
    chunk = max(1, min(total // SHARE, MOST))
    salts = {n: max(1, -(-c // chunk)) for n, c in counts.items()}
    salt_of = spark.createDataFrame(sorted(salts.items()) or [(0, 1)], "length long, salts long")
    salted = cut.join(F.broadcast(salt_of), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("salts"))).drop("salts")
    groups = sorted((r.length, r.salt, r["count"]) for r in salted.groupBy("length", "salt").count().collect())
    firsts, seen = {}, {}
    for n, salt, c in groups:
        firsts[n, salt] = seen.get(n, 0)
        seen[n] = firsts[n, salt] + c
    shared = spark.sparkContext.broadcast((firsts, places(plan(counts, capacity))))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(w)).select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, place = shared.value
        for batch in batches:
            length, salt, rank = (np.array(batch.column(k), np.int64) for k in (3, 5, 6))
            order = np.lexsort((salt, length))
            edges = np.flatnonzero(np.diff(length[order]) | np.diff(salt[order])) + 1
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for own in np.split(order, edges) if len(order) else []:
                n = int(length[own[0]])
                starts, ids, offsets = place[n]
                r = first[n, int(salt[own[0]])] + rank[own] - 1
                k = np.searchsorted(starts, r, side="right") - 1
                seq[own], off[own] = ids[k] + r - starts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, cuts and packs; nothing is sorted or gathered beyond (length, salt) groups of bounded share."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(materialise(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
