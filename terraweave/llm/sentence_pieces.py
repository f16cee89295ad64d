"""SentencePiece encoding and decoding by batched Viterbi search.

A text is cut into words where no piece of the model can cross. The distinct
words of a batch are grouped by length; all words of one length advance together:
for each end position the hashes of all substrings up to the longest piece probe
the sorted piece keys, a vectorised maximum over the starts picks the best score,
and the start is stored as backpointer. Characters that no piece covers become
byte pieces (or the unknown piece, if the model has none).

The result is the segmentation with the greatest sum of piece scores, the
earliest start on ties. The library encodes models of the merging kind by rank,
not by such a sum, so its ids differ there; decoding is the same, and restores
every text that has no literal U+2581.

Null texts have no ids and decode to the empty text. Texts are encoded whole;
repeated rows are encoded alike; other columns pass through.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from terraweave.llm.store import column_values
from terraweave.llm.unit_cache import UnitCache

SPACE = "▁"  # fixed value: the visible space of the format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the format
UNKNOWN_PENALTY = 10.0  # fixed value of the format
CACHE_BYTES = 48 << 20  # of the words that a worker keeps
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BATCH_CELLS = 1 << 20  # characters that advance together


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({5: 4, 1: 8}[kind], i)
            value, i = data[i:i + size], i + size
        yield tag >> 3, value


class Model:
    """Pieces, scores and the two search tables of a model file."""

    def __init__(self, content: bytes) -> None:
        self.pieces: list[str] = []
        scores, self.types, norm = [], [], {}
        for number, value in _fields(content):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2):
            raise ValueError("models with a character map are not supported")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.trim = bool(norm.get(4, 1))
        self.scores = np.array(scores, dtype=np.float32)
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            self.words = re.compile(r"(?s).+")
        else:
            self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
            if any("\n" in self.pieces[i] for i in usable):
                self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.lowest = np.float32(min((self.scores[i] for i in usable), default=0) - UNKNOWN_PENALTY)
        self.keys, self.ids = {}, {}
        by_length = defaultdict(list)
        for i in usable:
            by_length[len(self.pieces[i])].append(i)
        for n, members in by_length.items():
            rows = np.array([[ord(c) for c in self.pieces[i]] for i in members], dtype=np.uint64)
            keys = _fold(rows)
            order = np.argsort(keys)
            if len(np.unique(keys)) != len(keys):
                raise ValueError("two pieces share a key")
            self.keys[n], self.ids[n] = keys[order], np.array(members, dtype=np.int64)[order]
        self.byte_table = [self._plain(i) for i in range(len(self.pieces))]

    def _plain(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] in (CONTROL, UNUSED):
            return b""
        return " ⁇ ".encode() if self.types[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        by_length = defaultdict(list)
        for i, word in enumerate(words):
            by_length[len(word)].append(i)
        for length, members in by_length.items():
            step = max(1, BATCH_CELLS // max(length, 1))
            for lo in range(0, len(members) if length else 0, step):
                some = members[lo:lo + step]
                chars = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le", "surrogatepass"), "<u4")
                for i, ids in zip(some, self._viterbi(chars.reshape(len(some), length))):
                    out[i] = ids
        return out

    def _viterbi(self, chars: np.ndarray) -> list[np.ndarray]:
        n, length = chars.shape
        codes = chars.astype(np.uint64)
        best = np.full((n, length + 1), -np.inf, dtype=np.float32)
        best[:, 0] = 0
        start = np.zeros((n, length + 1), dtype=np.int32)
        piece = np.full((n, length + 1), -1, dtype=np.int32)  # -1: no piece, a character of its own
        # hashes[k] holds the key of the substring of length k that ends at the current position
        hashes: dict[int, np.ndarray] = {}
        for end in range(1, length + 1):
            last = codes[:, end - 1]
            hashes = {1: _mix(np.zeros(n, np.uint64), last)} | {
                k + 1: _mix(h, last) for k, h in hashes.items() if k < self.longest}
            single = False
            for k in sorted(hashes, reverse=True):  # from the earliest start
                if k not in self.keys:
                    continue
                keys = self.keys[k]
                at = np.minimum(np.searchsorted(keys, hashes[k]), len(keys) - 1)
                hit = keys[at] == hashes[k]
                if not hit.any():
                    continue
                ids = self.ids[k][at]
                score = np.where(hit, best[:, end - k] + self.scores[ids], -np.inf).astype(np.float32)
                better = score > best[:, end]
                best[better, end] = score[better]
                start[better, end] = end - k
                piece[better, end] = ids[better]
                if k == 1:
                    single = hit
            score = np.where(single, -np.inf, best[:, end - 1] + self.lowest).astype(np.float32)
            better = score > best[:, end]
            best[better, end], start[better, end], piece[better, end] = score[better], end - 1, -1
        return self._walk(chars, start, piece)

    def _walk(self, chars: np.ndarray, start: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
        """Follow the backpointers of all words at once; characters without a piece become bytes."""
        n, length = chars.shape
        at, rows, cols, ids = np.full(n, length), [], [], []
        live = np.arange(n)
        while len(live):
            end = at[live]
            rows.append(live)
            cols.append(end)
            ids.append(piece[live, end])
            at[live] = start[live, end]
            live = live[at[live] > 0]
        rows, cols, ids = (np.concatenate(x) for x in (rows, cols, ids))
        order = np.lexsort((cols, rows))
        rows, cols, ids = rows[order], cols[order], ids[order]
        bounds = np.searchsorted(rows, np.arange(n + 1))
        odd = set(rows[ids < 0].tolist())
        out = []
        for i in range(n):
            own = ids[bounds[i]:bounds[i + 1]]
            if i in odd:
                own = np.array([x for p, c in zip(own, cols[bounds[i]:bounds[i + 1]])
                                for x in ([p] if p >= 0 else self._spelled(int(chars[i, c - 1])))], dtype=np.int64)
            out.append(own)
        return out

    def _spelled(self, code: int) -> list[int]:
        raw = chr(code).encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def prepared(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.byte_table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _mix(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Key of a string made longer by one character."""
    out = (key ^ (code + np.uint64(1))) * MULTIPLIER
    return out ^ (out >> np.uint64(29))


def _fold(rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(rows), dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = _mix(key, rows[:, j])
    return key


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    """One per Python worker."""
    with open(path, "rb") as f:
        return Model(f.read())


class Encoder:
    """Whole texts to little-endian id bytes, words remembered."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        self.model, self.cache = model(path), UnitCache(cache_bytes, "<i4")

    def encode(self, texts: list[str]) -> list[bytes]:
        rows = [self.model.words.findall(self.model.prepared(t)) for t in texts]
        ids, sizes = self.cache.encode([w for row in rows for w in row], self.model.segment)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, rows)])]
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _wider(df: DataFrame, name: str, kind: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"{name} {kind}").fields])


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of ``text`` as array<int>; no shuffle."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches_of(batches):
            found = encoder(path).encode([t or "" for t in column_values(batch, text)])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    source = docs.drop(name) if name in docs.columns else docs
    return source.mapInArrow(add, _wider(source, name, "array<int>"))


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids of a row spell."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches_of(batches):
            column = batch.column(batch.schema.get_field_index(ids))
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(column).to_pylist())])
            texts = [model(path).decode(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    source = encoded.drop(name) if name in encoded.columns else encoded
    return source.mapInArrow(add, _wider(source, name, "string"))
