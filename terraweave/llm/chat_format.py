"""Chat transcripts assembled from columns of bytes, with loss masks, and read back.

A turn is written as ``<turn ROLE>``, newline, text, newline, ``</turn>``, newline.
In texts a backslash is doubled, and the ``<`` of ``<turn`` and ``</turn`` becomes
``\\l``; in roles every ``<`` is ``\\l`` and every ``>`` ``\\g``. So no text can end or
begin a turn, and taking the marks off again gives every role and text exactly.

Turns are sorted by range of conversation and turn, so one that holds most rows is
spread over tasks. A task takes slices of a few megabytes and computes in numpy the
lengths of all segments, their cumulative offsets and the place of every byte, and
copies headers and contents into one preallocated Arrow buffer. Each row of the
result is a part of one conversation: the whole of it, unless it goes over a border
of tasks or beyond ``PART_BYTES``. ``loss`` holds (start, length) of the texts of
the trained role, in bytes of the part as written; headers are never under it.

Turns are ordered by number (null first), then role and text; repeated rows are
turns of their own. Null roles and texts are empty, a null conversation is one of
its own. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from terraweave.llm.store import column_values
from terraweave.llm.tokens import chunks

OPENING, BODY, CLOSING = b"<turn ", b">\n", b"\n</turn>\n"
SLICE_BYTES = 2 << 20
PART_BYTES = 16 << 20
WINDOW = 1 << 20  # bytes that are placed at once
BACKSLASH, LESS, GREATER = b"\\<>"
_CODES = np.arange(256, dtype=np.uint8)
_CODES[[LESS, GREATER]] = list(b"lg")
_PLAIN = {b"\\": b"\\", b"l": b"<", b"g": b">"}
_MARK = re.compile(rb"\\([\\lg])")
PARTS = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start: long, length: long>>"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(joined bytes, bounds) of a string column, nulls empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def marked_in_role(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the bytes of roles that get a backslash."""
    return np.flatnonzero((data == BACKSLASH) | (data == LESS) | (data == GREATER))


def marked_in_text(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the bytes of texts that get a backslash: backslashes, and ``<`` before a control word."""
    less = np.flatnonzero(data == LESS)
    if len(less):
        end = bounds[np.searchsorted(bounds, less, side="right")]
        starts = np.zeros(len(less), dtype=bool)
        for word in (b"turn", b"/turn"):
            fits = less + len(word) < end
            for j, code in enumerate(word, 1):
                fits[fits] = data[less[fits] + j] == code
            starts |= fits
        less = less[starts]
    return np.union1d(np.flatnonzero(data == BACKSLASH), less)


def scatter(out: np.ndarray, data: np.ndarray, bounds: np.ndarray, marked: np.ndarray, starts: np.ndarray) -> None:
    """Copy each row of ``data`` to its start in ``out``, a backslash before each marked byte."""
    shift = starts - bounds[:-1] - np.searchsorted(marked, bounds[:-1])
    for a in range(0, len(data), WINDOW):
        b = min(a + WINDOW, len(data))
        row = slice(np.searchsorted(bounds, a, side="right") - 1, np.searchsorted(bounds, b, side="left"))
        sizes = np.diff(np.clip(bounds[row.start:row.stop + 1], a, b))
        low, high = np.searchsorted(marked, [a, b])
        more = np.zeros(b - a, dtype=np.int64)
        more[marked[low:high] - a] = 1
        place = np.arange(a, b) + np.repeat(shift[row], sizes) + low + np.cumsum(more)
        out[place] = data[a:b]
        own = place[marked[low:high] - a]
        out[own] = _CODES[data[marked[low:high]]]
        out[own - 1] = BACKSLASH


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, turn bounds, starts of texts, lengths of texts) of all turns in order, in bytes as written."""
    role, role_bounds = _bytes_of(roles)
    text, text_bounds = _bytes_of(texts)
    role_marks, text_marks = marked_in_role(role, role_bounds), marked_in_text(text, text_bounds)
    longer = lambda bounds, marks: np.diff(bounds) + np.diff(np.searchsorted(marks, bounds))
    role_sizes, text_sizes = longer(role_bounds, role_marks), longer(text_bounds, text_marks)
    fixed = len(OPENING) + len(BODY) + len(CLOSING)
    bounds = np.concatenate([[0], np.cumsum(role_sizes + text_sizes + fixed)]).astype(np.int64)
    role_starts = bounds[:-1] + len(OPENING)
    text_starts = role_starts + role_sizes + len(BODY)
    buffer = pa.allocate_buffer(int(bounds[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for start, piece in ((bounds[:-1], OPENING), (role_starts + role_sizes, BODY), (text_starts + text_sizes, CLOSING)):
        out[start[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    scatter(out, role, role_bounds, role_marks, role_starts)
    scatter(out, text, text_bounds, text_marks, text_starts)
    return buffer, bounds, text_starts, text_sizes


def _changes(ids: pa.Array) -> np.ndarray:
    """Places where a conversation starts."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy()
    return np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices that end between conversations, unless one is beyond ``PART_BYTES``."""
    held: list[pa.RecordBatch] = []
    for piece in chunks(batches, size=SLICE_BYTES):
        held.append(piece)
        table = pa.concat_batches(held) if len(held) > 1 else piece
        last = int(_changes(table.column(0))[-1])
        if last:
            yield table.slice(0, last)
            held = [table.slice(last)]
        elif table.nbytes >= PART_BYTES:
            yield table
            held = []
    if held:
        yield pa.concat_batches(held)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 trained: str = "assistant") -> DataFrame:
    """Parts of conversations in order of (conv_id, part); see the module for what they hold."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for rows in _slices(batches):
            ids, roles, texts = (rows.column(i) for i in (0, 2, 3))
            buffer, bounds, starts, sizes = assemble(roles, texts)
            first = _changes(ids)
            last = np.append(first[1:], len(ids))
            begins = bounds[first]
            offsets = pa.py_buffer(np.append(begins, bounds[-1]).astype(np.int32))
            under = np.flatnonzero(pc.fill_null(pc.equal(roles, trained), False).to_numpy(zero_copy_only=False))
            owner = np.searchsorted(first, under, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(starts[under] - begins[owner]), pa.array(sizes[under])], ["start", "length"])
            loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(first)), pa.array(part + np.arange(len(first))), pa.array(last - first),
                pa.StringArray.from_buffers(len(first), offsets, buffer), loss],
                ["conv_id", "part", "n_turns", "formatted", "loss"])
            part += len(first)

    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return (rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(write, PARTS))


def unmarked(raw: bytes) -> bytes:
    """A role or text as it was before its control strings were marked."""
    return _MARK.sub(lambda m: _PLAIN[m[1]], raw) if b"\\" in raw else raw


def parse(formatted: bytes) -> Iterator[tuple[bytes, bytes, int]]:
    """(role, text, start of the text as written) of each turn."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPENING, at):
            raise ValueError(f"no turn starts at byte {at}")
        body = formatted.index(BODY, at)
        start = body + len(BODY)
        end = formatted.index(CLOSING, start)
        yield unmarked(formatted[at + len(OPENING):body]), unmarked(formatted[start:end]), start
        at = end + len(CLOSING)


def read_turns(parts: DataFrame) -> DataFrame:
    """(conv_id, part, nth, role, text, trained): the turns of each part, ``trained`` where the loss mask covers the text."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "nth", "role", "text", "trained"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for conv_id, part, formatted, loss in zip(*(column_values(batch, c) for c in ("conv_id", "part", "formatted", "loss"))):
                covered = {x["start"] for x in loss}
                out = [(conv_id, part, nth, role.decode(), text.decode(), start in covered)
                       for nth, (role, text, start) in enumerate(parse(formatted.encode()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return parts.mapInArrow(read, "conv_id long, part long, nth int, role string, text string, trained boolean")


def _points(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


class _Sums:
    """Running digests of one conversation."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars, self.all, self.loss = 0, 0, 0, sha256(), sha256()

    def add(self, formatted: bytes, loss: list[dict]) -> None:
        self.chars += _points(formatted)
        for role, text, _ in parse(formatted):
            self.turns += 1
            self.all.update(b"%b\n%b\n" % (role, text))
        for span in loss:
            text = unmarked(formatted[span["start"]:span["start"] + span["length"]])
            self.loss_chars += _points(text)
            self.loss.update(text)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read out of the parts.

    A digest follows a conversation from its first byte to its last, so its parts meet in one task, which holds one part
    at a time.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        sums, current = None, None
        for batch in batches:
            done = []
            for conv_id, formatted, loss in zip(*(column_values(batch, c) for c in ("conv_id", "formatted", "loss"))):
                if sums is None or conv_id != current:
                    if sums is not None:
                        done.append(sums.row(current))
                    sums, current = _Sums(), conv_id
                sums.add(formatted.encode(), loss)
            if done:
                yield table(done)
        if sums is not None:
            yield table([sums.row(current)])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
