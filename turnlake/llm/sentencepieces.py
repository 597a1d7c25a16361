"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file and composed, state by state, with each segment of the input:

* the normaliser: blanks to U+2581, one of them added before the text (models with a character map are refused);
* the piece lexicon: one arc a piece, weight -score; characters that no piece covers go through a byte-fallback
  sub-machine, one arc a byte;
* the neighbour acceptor: for BPE models a pair of pieces (u, v) is admitted if the merges leave exactly u | v when
  they are run on their joined text. Any other pair has the weight infinity. A BPE segmentation is the one path all of whose
  neighbours are admitted, so merge order needs no search. Unigram models admit every pair.

The result is the path of least weight in the tropical semiring (min, +). No merge can cross a blank that follows another
character, nor two characters that stand together in no piece, so segments are solved apart and remembered (bounded)."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import Memo, table

BLANK = "▁"
INF = float("inf")
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class PieceTransducer:
    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.weight: list[float] = []
        self.byte_id: dict[int, int] = {}
        self.unknown, self.bpe, self.dummy, self.squeeze = 0, False, True, True
        for field, value in _fields(model):
            if field == 1:
                d = dict(_fields(value))
                piece, kind, k = d[1].decode(), d.get(3, NORMAL), len(self.pieces)
                self.pieces.append(piece)
                self.weight.append(-struct.unpack("<f", d.get(2, b"\0" * 4))[0])
                if kind in (NORMAL, USER, UNUSED):
                    self.ids[piece] = k
                elif kind == BYTE:
                    self.byte_id[int(piece[3:5], 16)] = k
                elif kind == UNKNOWN:
                    self.unknown = k
            elif field == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                d = dict(_fields(value))
                if d.get(2):
                    raise ValueError("models with a character map aren't supported")
                self.dummy, self.squeeze = bool(d.get(3, 1)), bool(d.get(4, 1))
        if self.squeeze or any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("models that squeeze blanks or hold them within pieces aren't supported")
        self.longest = max(map(len, self.ids))
        self.alphabet = set("".join(self.ids))
        byte_of = {k: bytes([b]) for b, k in self.byte_id.items()}
        real = set(self.ids.values())
        self.out = [byte_of[k] if k in byte_of else p.replace(BLANK, " ").encode() if k in real else b" \xe2\x81\x87 " if k == self.unknown else b"" for k, p in enumerate(self.pieces)]
        self.heads = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.last_merge = Memo(lambda p: self._merged(p, stop=2), 1_000_000)
        self.pairs = Memo(self._admitted, 500_000)
        self.apart = Memo(self._packed, 200_000)
        self.after_blank = Memo(lambda w: self._cut(BLANK + w), 400_000)
        self.bare = Memo(self._cut, 60_000)
        self.lines_apart = "\n" not in self.alphabet

    def _merged(self, text: str, stop: int = 1) -> list[str]:
        """The pieces left when every merge is done, least weight first, leftmost first; stop: or when so many are left."""
        parts = list(text)
        while len(parts) > stop:
            best = min((self.weight[k], i) if (k := self.ids.get(parts[i] + parts[i + 1])) is not None else (INF, i) for i in range(len(parts) - 1))
            if best[0] == INF:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _admitted(self, pair: int) -> bool:
        """Whether the merges of both pieces' joined text leave this pair: merges are taken back, the last one first; at no
        time may the two pieces at the border have had a merge of their own that comes before."""
        u, v = self.pieces[pair >> 20], self.pieces[pair & 0xFFFFF]
        if BLANK * 2 in u + v:  # pieces of blanks share one weight, so their order isn't known from it
            return self._merged(u + v) == [u, v]
        ids, weight, limit, left = self.ids, self.weight, INF, False
        while True:
            k = ids.get(u + v)
            if k is not None and (weight[k] < limit or (left and weight[k] == limit)):
                return False
            wu = weight[ids[u]] if len(u) > 1 else -INF
            wv = weight[ids[v]] if len(v) > 1 else -INF
            if wu == wv == -INF:
                return True
            if wu > wv:  # of equals the left one came first, so the right one goes first
                limit, left, u = wu, False, self.last_merge[u][1]
            else:
                limit, left, v = wv, True, self.last_merge[v][0]

    def _cut(self, segment: str) -> bytes:
        """A segment cut between characters that stand together in no piece, for no path's piece can cross there."""
        inside, at, out = self.inside, 0, []
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in inside:
                out.append(self.apart[segment[at:k]])
                at = k
        if not at:
            return self._packed(segment)
        out.append(self.apart[segment[at:]])
        return b"".join(out)

    def _only_path(self, segment: str) -> list[int]:
        """shortest_path for BPE. All but one path through the composed machine weigh infinity, so the arcs from a state are
        tried longest first, and a state (place, last piece) from which none leads on is never entered again. Ids; -1 - place
        stands for an uncovered character."""
        heads, pairs, n = self.heads, self.pairs, len(segment)
        dead: set = set()
        path: list[int] = []
        ends: list[int] = [0]
        waiting: list[list] = []
        at = 0
        while True:
            arcs, k = [], at + 1
            while k <= n and (piece := heads.get(segment[at:k])) is not None:
                if piece >= 0:
                    arcs.append((k, piece))
                k += 1
            if not arcs:
                arcs.append((at + 1, -1 - at))
            while True:
                last = path[-1] if path else -1
                found = False
                while arcs:
                    k, piece = arcs.pop()
                    if (last < 0 or piece < 0 or pairs[last << 20 | piece]) and (k, piece) not in dead:
                        found = True
                        break
                if found:
                    break
                if not path:
                    raise ValueError(f"no path through {segment!r}")
                dead.add((ends.pop(), path.pop()))
                arcs = waiting.pop()
            path.append(piece)
            ends.append(k)
            waiting.append(arcs)
            at = k
            if at == n:
                return path

    def shortest_path(self, segment: str) -> list[str]:
        """The least-weight path through normalised text: its pieces and uncovered characters."""
        n = len(segment)
        ids, weight, longest = self.ids, self.weight, self.longest
        # The states before place i are (i, last piece); `live[i]` holds their least weights and back-pointers.
        live: list[dict] = [{} for _ in range(n + 1)]
        live[0][""] = (0.0, None)
        for end in range(1, n + 1):
            states = live[end]
            for start in range(max(0, end - longest), end):
                before = live[start]
                if not before:
                    continue
                piece = segment[start:end]
                k = ids.get(piece)
                if k is None:
                    if end - start > 1:
                        continue
                    arc = 1e6
                else:
                    arc = weight[k]
                least, via = INF, None
                for last, (w, _) in before.items():
                    if w + arc < least:
                        least, via = w + arc, last
                if via is not None:
                    states[piece] = (least, via)
        path, at = [], n
        if n and not live[n]:
            raise ValueError("no path")
        piece = min(live[n], key=lambda p: live[n][p][0]) if n else ""
        while at:
            path.append(piece)
            piece, at = live[at][piece][1], at - len(piece)
        return path[::-1]

    def _packed(self, segment: str) -> bytes:
        if self.bpe:
            path = self._only_path(segment)
            if min(path) >= 0:
                return struct.pack(f"<{len(path)}I", *path)
            named = [self.pieces[k] if k >= 0 else segment[-1 - k] for k in path]
        else:
            named = self.shortest_path(segment)
        out = []
        for piece in named:
            k = self.ids.get(piece)
            if k is not None:
                out.append(k)
            elif self.byte_id:
                out += [self.byte_id[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers. An empty text has none."""
        if not text:
            return b""
        if BLANK in text:
            text = text.replace(BLANK, " ")
        out = []
        for at, line in enumerate(text.split("\n") if self.lines_apart else [text]):
            words = line.split(" ")
            if at:
                out.append(self.bare["\n"])
            if "" in words[1:] or not words[0]:
                whole = (" " if not at and self.dummy else "") + line
                for s in re.findall(" *[^ ]+| +", whole):
                    out.append(self.after_blank[s[1:].replace(" ", BLANK)] if s[0] == " " else self.bare[s])
                continue
            out.append(self.after_blank[words[0]] if not at and self.dummy else self.bare[words[0]])
            out += map(self.after_blank.__getitem__, words[1:])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The inverse: pieces and bytes back to text, without the added blank."""
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if self.dummy and raw[:1] == b" " else raw).decode(errors="replace")


_compiled: dict[bytes, PieceTransducer] = {}


def _transducer(model: bytes) -> PieceTransducer:
    key = hashlib.sha256(model).digest()
    if key not in _compiled:
        _compiled[key] = PieceTransducer(model)
    return _compiled[key]


def encode_documents(docs: DataFrame, model_path: str, ids: bool = True) -> DataFrame:
    """doc_id, ids array<int> (left out if not `ids`), n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, round_trip.

    Null and empty texts have no pieces. round_trip: decoding gives the text again (U+2581 counts as the blank it becomes)."""
    with open(model_path, "rb") as f:  # the driver's own file; its half megabyte is broadcast
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, " + "ids array<int>, " * ids + "n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(model.value)
        is_byte = np.zeros(len(t.pieces), bool)
        is_byte[list(t.byte_id.values())] = True
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                text = text or ""
                packed = t.encode(text)
                numbers, back = np.frombuffer(packed, "<u4"), t.decode(packed)
                for c, v in zip(cols, (numbers.astype(np.int32) if ids else None, len(numbers), int(is_byte[numbers].sum()), zlib.crc32(packed), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(BLANK, " "))):
                    c.append(v)
            arrays = [batch.column(0), *([pa.array(cols[0], pa.list_(pa.int32()))] if ids else []), *(pa.array(c, k) for c, k in zip(cols[1:], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again; the ids' digest stands for them."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)
