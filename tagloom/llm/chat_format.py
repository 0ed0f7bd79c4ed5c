"""Chat formatting by columnar byte assembly.

Each turn becomes ``<|turn|>role\\n`` text ``<|end|>\\n``. For a whole Arrow batch the segment
lengths are computed first, their running total gives every offset, and bytes of roles, texts and
marks are scattered into one preallocated buffer that becomes the Arrow column as it is. A formatted
conversation is its turns in order, so formatting moves no rows and no conversation is too long.

Control strings inside texts are escaped: a backslash goes before every backslash and between the
first two bytes of ``<|``, ``<s``, ``</``, ``[I`` and ``[/``. Dropping one backslash before each
escaped byte restores the text exactly.

Reading back needs the turns of a conversation in order (a digest is a sequential sum), so turns are
shuffled by ``conv_id`` and sorted on disk; a task streams them and keeps one turn and two digests,
however long the conversation.

Defined results: null text or role is empty; equal ``turn`` numbers are ordered by role, then text; a null
``turn`` comes first; rows with a null ``conv_id`` form one conversation; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import ship

HEAD, SEPARATOR, TAIL = b"<|turn|>", b"\n", b"<|end|>\n"
ESCAPE = ord("\\")
# Second bytes, by first byte, of the strings that must not appear in a text.
CONTROL = {ord("<"): b"|s/", ord("["): b"I/"}
SLICE_BYTES = 4 << 20
FORMATTED = "conv_id bigint, turn bigint, role string, text string, formatted string, loss_start bigint, loss_end bigint"
READ_BACK = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets, without copies."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return values, offsets - offsets[0]


def _escapes(values: np.ndarray, offsets: np.ndarray, newline: bool) -> np.ndarray:
    """True where a backslash goes before the byte."""
    need = values == ESCAPE
    if newline:
        need |= values == ord("\n")
    follows = np.ones(len(values), bool)
    starts = offsets[:-1]
    follows[starts[starts < len(values)]] = False
    for first, seconds in CONTROL.items():
        after = np.flatnonzero(values[:-1] == first) + 1
        after = after[follows[after]]
        need[after] |= np.isin(values[after], np.frombuffer(seconds, np.uint8))
    return need


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One formatted string per row, and where its text starts and ends in it (bytes)."""
    columns = []
    for column, newline in ((roles, True), (texts, False)):
        values, offsets = _bytes_of(column)
        before = np.concatenate(([0], np.cumsum(_escapes(values, offsets, newline))))
        columns.append((values, offsets, before, np.diff(offsets) + np.diff(before[offsets])))
    role_len, text_len = columns[0][3], columns[1][3]
    fixed = len(HEAD) + len(SEPARATOR) + len(TAIL)
    ends = np.cumsum(fixed + role_len + text_len)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    role_at = starts + len(HEAD)
    text_at = role_at + role_len + len(SEPARATOR)
    for mark, at in ((HEAD, starts), (SEPARATOR, text_at - len(SEPARATOR)), (TAIL, ends - len(TAIL))):
        for k, byte in enumerate(mark):
            out[at + k] = byte
    for (values, offsets, before, _), at in zip(columns, (role_at, text_at)):
        # A byte's place: start of its row, bytes and escapes before it in the row, its own escape.
        shift = at - offsets[:-1] - before[offsets[:-1]]
        place = np.repeat(shift, np.diff(offsets)) + np.arange(len(values)) + before[1:]
        out[place] = values
        out[place[np.diff(before) > 0] - 1] = ESCAPE
    bounds = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64))
    made = pa.LargeStringArray.from_buffers(len(roles), bounds, pa.py_buffer(out))
    return made, text_at - starts, text_at - starts + text_len


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of bounded bytes; a single longer row is a piece of its own."""
    sizes = np.diff(_bytes_of(batch["text"])[1]) + np.diff(_bytes_of(batch["role"])[1])
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > SLICE_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield batch.slice(first)


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn's ``formatted`` string; ``loss_start``, ``loss_end``: bytes under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                made, start, end = assemble(batch["role"], batch["text"])
                masked = np.asarray([r == "assistant" for r in batch["role"].to_pylist()], bool)
                columns = [batch["conv_id"], batch["turn"], batch["role"], batch["text"], made.cast(pa.string())]
                columns += [pa.array(np.where(masked, x, 0)) for x in (start, end)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FORMATTED.split(", ")])

    ship(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, FORMATTED)


TURN = re.compile(rb"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|end\|>\n", re.DOTALL)
ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def unescape(text: bytes) -> bytes:
    return ESCAPED.sub(rb"\1", text) if b"\\" in text else text


class _Conversation:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: bytes, start: int, end: int) -> None:
        for role, text in TURN.findall(formatted):
            self.turns += 1
            for part in (unescape(role), b"\n", unescape(text), b"\n"):
                self.all.update(part)
        learnt = unescape(formatted[start:end])
        self.loss.update(learnt)
        self.loss_chars += len(learnt.decode())
        self.chars += len(formatted.decode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns, texts under the loss mask, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_BACK.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now: _Conversation | None = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            done = []
            ids, starts, ends = (batch[c].to_pylist() for c in ("conv_id", "loss_start", "loss_end"))
            for conv_id, text, start, end in zip(ids, batch["formatted"].cast(pa.large_binary()), starts, ends):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(text.as_py(), start, end)
            if done:
                yield made(done)
        if now is not None:
            yield made([now.row()])

    ship(formatted.sparkSession)
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, READ_BACK)
