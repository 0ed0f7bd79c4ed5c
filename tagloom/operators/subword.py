"""Subword encoding and decoding with character offsets, for a given byte-pair vocabulary.

The vocabulary is a file of tokens and ranks and is never learnt here. Tag tokens are reserved: they are cut
out before anything else, never split and never part of another token. The text between them is divided
into pieces by a pattern, and in a piece the neighbouring tokens whose union has the lowest rank are
joined, until no union is a token. Rows are encoded inside Arrow batches, nothing is shuffled; the
vocabulary is broadcast, and its size is checked first.

Ids: the specials, the reserved tokens, then the ranks of the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.vocab import EOS, PAD, RESERVED, SPECIALS, UNK

MOST_BYTES = 64 << 20  # of a vocabulary file
MEMO_PIECES = 200_000  # pieces that a worker remembers
SHORT_PIECE = 64  # longer pieces are not remembered

# Fixed value: the public pattern of byte-level vocabularies.
PIECE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PARTS = ("ids", "starts", "ends")
CODED = "struct<ids: array<int>, starts: array<int>, ends: array<int>>"


@dataclass(frozen=True)
class SubwordVocabulary:
    """Token ranks and the strings that are never split."""

    ranks: dict[bytes, int]
    reserved: tuple[str, ...] = RESERVED
    pattern: str = PIECE_PATTERN

    @classmethod
    def read(cls, path: str, reserved: Sequence[str] = RESERVED, pattern: str = PIECE_PATTERN) -> SubwordVocabulary:
        """From a file with a base64 token and its rank per line."""
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if lost := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{path} has no token for the bytes {lost}")
        return cls(ranks, tuple(reserved), pattern)

    @property
    def first_rank(self) -> int:
        return len(SPECIALS) + len(self.reserved)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of a piece. A heap holds the unions that are tokens, so the work is n log n for any piece."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return [piece] if n else []
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at a byte

    def union(i: int) -> tuple[int, int, int] | None:
        if i < 0 or end[i] >= n:
            return None
        rank = ranks.get(piece[i : end[end[i]]])
        return None if rank is None else (rank, i, end[end[i]])

    heap = [u for i in range(n - 1) if (u := union(i))]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        # Joins made since then may have taken one of the two tokens.
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        for u in (union(before[i]), union(i)):
            if u:
                heapq.heappush(heap, u)
    tokens, i = [], 0
    while i < n:
        tokens.append(piece[i : end[i]])
        i = end[i]
    return tokens


class SubwordEncoder:
    """Encodes texts of one worker; pieces seen before are looked up."""

    def __init__(self, vocabulary: SubwordVocabulary):
        self.ranks, self.first = vocabulary.ranks, vocabulary.first_rank
        self.pieces = regex.compile(vocabulary.pattern)
        longest_first = sorted(vocabulary.reserved, key=len, reverse=True)
        self.reserved = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.reserved_id = {t: len(SPECIALS) + i for i, t in enumerate(vocabulary.reserved)}
        self.known: dict[str, tuple[list[int], list[int], list[int]]] = {}

    def _piece(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, and the characters of the piece that hold the first and the last byte of each token."""
        coded = self.known.get(text)
        if coded is None:
            raw = text.encode()
            tokens = merge(raw, self.ranks)
            ids, starts, ends, at, chars = [], [], [], 0, 0
            for token in tokens:
                # A byte that continues a character belongs to the character before the count.
                starts.append(chars - ((raw[at] & 0xC0) == 0x80))
                chars += sum((b & 0xC0) != 0x80 for b in token)
                at += len(token)
                ends.append(chars)
                ids.append(self.ranks[token] + self.first)
            coded = ids, starts, ends
            if len(text) <= SHORT_PIECE:
                if len(self.known) >= MEMO_PIECES:
                    self.known.clear()
                self.known[text] = coded
        return coded

    def _parts(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """Where each part starts, its text, and whether it is a reserved token."""
        done = 0
        for hit in self.reserved.finditer(text) if self.reserved else ():
            for piece in self.pieces.finditer(text[done : hit.start()]):
                yield done + piece.start(), piece[0], False
            yield hit.start(), hit[0], True
            done = hit.end()
        for piece in self.pieces.finditer(text[done:] if done else text):
            yield done + piece.start(), piece[0], False

    def encode(self, text: str, limit: int | None) -> dict[str, list[int]]:
        """At most ``limit`` ids, the end mark included; offsets are characters of the text."""
        most = None if limit is None else max(limit - 1, 0)
        ids, starts, ends = [], [], []
        for at, part, whole in self._parts(text):
            if most is not None and len(ids) >= most:
                break
            own = ([self.reserved_id[part]], [0], [len(part)]) if whole else self._piece(part)
            ids += own[0]
            starts += [at + k for k in own[1]]
            ends += [at + k for k in own[2]]
        cut = most is not None and len(ids) >= most
        if cut:
            del ids[most:], starts[most:], ends[most:]
        last = (ends[-1] if ends else 0) if cut else len(text)
        return {"ids": ids + [EOS], "starts": starts + [last], "ends": ends + [last]}


def _lists(offsets: array, values: array) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        *[pa.Array.from_buffers(pa.int32(), len(a), [None, pa.py_buffer(a)]) for a in (offsets, values)]
    )


def _code(encoder: SubwordEncoder, batch: pa.Array, limit: int | None) -> pa.StructArray:
    """One text at a time: a batch of whole documents has millions of ids, too many for Python objects."""
    flat, offsets = {name: array("i") for name in PARTS}, array("i", [0])
    for text in batch:
        own = encoder.encode(text.as_py() or "", limit)
        for name, values in flat.items():
            values.extend(own[name])
        offsets.append(len(flat["ids"]))
    return pa.StructArray.from_arrays([_lists(offsets, flat[name]) for name in PARTS], names=list(PARTS))


def encode_subwords(
    texts: DataFrame, vocabulary: SubwordVocabulary, columns: dict[str, tuple[str, int | None]]
) -> DataFrame:
    """``texts`` with ``ids``, ``starts`` and ``ends`` per entry of ``columns``: its name -> text column, limit.

    The columns are structs of three arrays of equal length. Every row stays; a null text has the end
    mark only.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    made: list[SubwordEncoder] = []  # one per worker and plan, filled when the first batch comes

    def coder(limit: int | None):
        def run(batch: pa.Array) -> pa.Array:
            if not made:
                made.append(SubwordEncoder(shared.value))
            return _code(made[0], batch, limit)

        return F.arrow_udf(run, CODED)

    return texts.withColumns({name: coder(limit)(F.col(text)) for name, (text, limit) in columns.items()})


def decode_subwords(coded: DataFrame, vocabulary: SubwordVocabulary, columns: dict[str, str]) -> DataFrame:
    """``coded`` with one text column per entry of ``columns``: its name -> id column.

    Special and unknown ids are left out. Bytes of a character that was cut off become U+FFFD.
    """
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)
    tokens: dict[int, bytes] = {}

    def run(batch: pa.Array) -> pa.Array:
        if not tokens:
            own = shared.value
            tokens.update({rank + own.first_rank: token for token, rank in own.ranks.items()})
            tokens.update({len(SPECIALS) + i: t.encode() for i, t in enumerate(own.reserved)})
            tokens.update(dict.fromkeys((PAD, EOS, UNK), b""))
        texts = []
        for ids in batch:
            raw = b"".join([tokens.get(i, b"") for i in ids.values.to_pylist()]) if ids.is_valid else b""
            texts.append(raw.decode(errors="replace"))
        return pa.array(texts, pa.string())

    decode = F.arrow_udf(run, "string")
    return coded.withColumns({name: decode(F.col(ids)) for name, ids in columns.items()})
