"""Token counts by prefix dynamic programming.

A text splits into pieces that byte-pair encoding never crosses. Inside a piece the last token of
every prefix follows from the last tokens of shorter prefixes: token ``t`` may end at byte ``i`` if
the prefix before it ends in a token that stands next to ``t`` under the merge rules. One pass so
gives the exact count at every prefix. Running totals over pieces extend that to the text, so
"how many tokens in the first n characters" and "how many characters fit a budget" are look-ups
and never encode the text again.

Defined results: a null text is empty and has no tokens; texts may have any length; repeated rows
are counted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import ship

VOCABULARY = "byte_bpe_50k"
LIMIT = 512
MEMO = 300_000  # entries of each memo of a worker
COUNTS = "struct<n_tokens: bigint, fits: bigint>"


class PrefixCounter:
    """Counts for one vocabulary; memos are dropped when full, which only costs time."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str = public_tokenizers.PATTERN):
        with open(ranks_path, "rb") as lines:
            self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as file:
            added = [t["content"] for t in json.load(file)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.rank))
        self.adjacent: dict[tuple[bytes, bytes], bool] = {}
        self.totals: dict[str, int] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain byte-pair encoding: join the pair of lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            joined = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == 1 << 60:
                break
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, a: bytes, b: bytes) -> bool:
        known = self.adjacent.get((a, b))
        if known is None:
            if len(self.adjacent) >= MEMO:
                self.adjacent.clear()
            known = self.adjacent[a, b] = self.merged(a + b) == [a, b]
        return known

    def piece_prefixes(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of a piece; item 0 is the empty prefix."""
        rank, longest = self.rank, self.longest
        counts, last = [0], [b""]
        for i in range(1, len(piece) + 1):
            for start in range(max(0, i - longest), i):
                token = piece[start:i]
                if token in rank and (not start or self._fits(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def _total(self, piece: str) -> int:
        if len(self.totals) >= MEMO:
            self.totals.clear()
        raw = piece.encode()
        n = self.totals[piece] = 1 if raw in self.rank else self.piece_prefixes(raw)[-1]
        return n

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; special strings are pieces of their own."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out, done = [], 0
        for m in self.special.finditer(text):
            out += [*self.pattern.findall(text[done : m.start()]), m[0]]
            done = m.end()
        return out + self.pattern.findall(text[done:])

    def _counted(self, pieces: list[str]) -> list[int]:
        known = list(map(self.totals.get, pieces))
        if None in known:
            special = self.special.fullmatch if self.special else lambda _: None
            known = [
                (1 if special(p) else self.totals.get(p) or self._total(p)) if n is None else n
                for p, n in zip(pieces, known)
            ]
        return known

    def prefixes(self, text: str) -> TextPrefixes:
        pieces = self.pieces(text)
        return TextPrefixes(self, pieces, list(accumulate(self._counted(pieces), initial=0)))


class TextPrefixes:
    """Exact counts at every prefix of one text."""

    def __init__(self, counter: PrefixCounter, pieces: list[str], counts: list[int]):
        self.counter, self.pieces, self.counts = counter, pieces, counts

    def total(self) -> int:
        return self.counts[-1]

    @property
    def ends(self) -> list[int]:
        return list(accumulate(map(len, self.pieces), initial=0))

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters, as if the text ended there."""
        ends = self.ends
        k = bisect_left(ends, chars)
        if k == len(ends):
            return self.counts[-1]
        if not k:
            return 0
        # Space at the cut is one piece, wherever the whole text divides it.
        first = k - 1
        while first and self.pieces[first - 1].isspace():
            first -= 1
        open_part = "".join(self.pieces[first:k])[: chars - ends[first]]
        return self.counts[first] + sum(self._part(p) for p in self.counter.pieces(open_part))

    def _part(self, piece: str) -> int:
        if self.counter.special and self.counter.special.fullmatch(piece):
            return 1
        return self.counter.piece_prefixes(piece.encode())[-1]

    def within(self, budget: int) -> int:
        """The most characters whose whole pieces fit ``budget`` tokens."""
        k = bisect_left(self.counts, budget + 1) - 1
        return sum(map(len, self.pieces[:k]))


@cache
def counter(json_path: str, ranks_path: str) -> PrefixCounter:
    return PrefixCounter(json_path, ranks_path)


def count_tokens(text: Column, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> Column:
    """``n_tokens``, and ``fits``: the characters of whole pieces within ``limit`` tokens."""
    paths = [public_tokenizers.path(f"{vocabulary}.{kind}") for kind in ("json", "tiktoken")]

    def count(texts: pa.Array) -> pa.Array:
        own = counter(*paths)
        totals, fits = [], []
        for t in texts:
            prefixes = own.prefixes(t.as_py() or "")
            totals.append(prefixes.total())
            fits.append(prefixes.within(limit))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (totals, fits)], names=["n_tokens", "fits"])

    return F.arrow_udf(count, COUNTS).asNondeterministic()(text)


def token_counts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, chars_within``."""
    ship(docs.sparkSession)
    counted = docs.select("doc_id", "text", count_tokens(F.col("text"), limit).alias("counted"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("counted.n_tokens"),
        (F.col("counted.n_tokens") > limit).alias("over_limit"),
        F.col("counted.fits").alias("chars_within"),
    )
