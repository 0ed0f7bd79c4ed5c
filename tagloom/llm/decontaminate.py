"""Benchmark decontamination with a generalised suffix automaton.

All benchmark items go into one automaton over their words. A document's words are streamed through
it; the state and the length of the longest match at each word tell which 13-word windows (or whole
shorter items) end there. Words inside any such window are hit; a document is contaminated when the
hit share reaches the limit. Row-local: documents are never shuffled.

Items are cut into blocks of at most ``block_words`` words, each with an automaton that fits a
broadcast. With several blocks the documents are written once, their texts are read once per block, and only
hits are written in between.

Defined results: a null or empty text has no words; items without words match nothing; an item with
a null id hits words but is not listed; repeated rows are judged alike; an empty benchmark hits
nothing; all columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import ship
from tagloom.session import materialise

WINDOW = 13
BLOCK_WORDS = 100_000
HIT_TYPE = "struct<n_words: bigint, starts: array<bigint>, ends: array<bigint>, items: array<bigint>>"

# Digits, letters and bytes of other scripts make words; A-Z is lowered, all else separates.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; state 0 is the root."""

    window: int
    ids: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    window_state: list[int] = field(default_factory=list)
    window_items: dict[int, set[int | None]] = field(default_factory=dict)
    short_items: dict[int, list[tuple[int, int | None]]] = field(default_factory=dict)
    shortest: int = 1 << 60

    @classmethod
    def build(cls, items: list[tuple[int | None, bytes]], window: int) -> Automaton:
        self = cls(window)
        coded = []
        for item_id, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            if words:
                coded.append((item_id, words))
                last = 0
                for w in words:
                    last = self._extend(last, w)
        self._index(coded)
        return self

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of state ``q`` that is exactly one word longer than ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _index(self, coded: list[tuple[int | None, list[int]]]) -> None:
        """Which items each window state belongs to, and where short items end."""
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.window_state = [-1] * len(self.next)
        for s in order:
            if self.length[s] >= self.window:
                above = self.link[s]
                self.window_state[s] = s if self.length[above] < self.window else self.window_state[above]
        for item_id, words in coded:
            self.shortest = min(self.shortest, self.window, len(words))
            s = 0
            for i, w in enumerate(words):
                s = self.next[s][w]
                if i + 1 >= self.window:
                    self.window_items.setdefault(self.window_state[s], set()).add(item_id)
            if len(words) < self.window:
                self.short_items.setdefault(s, []).append((len(words), item_id))
        for s in order[1:]:
            if inherited := self.short_items.get(self.link[s]):
                self.short_items[s] = self.short_items.get(s, []) + inherited

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set]:
        """Merged spans of hit words, and the items found."""
        starts, ends, items = [], [], set()
        n = len(words)
        if n < self.shortest:
            return starts, ends, items
        codes = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, n)
        # A match cannot cross a word that no item has, so only long enough runs are streamed.
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).astype(np.int8)))
        runs = edges.reshape(-1, 2)
        for first, end in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():
            self._stream(codes[first:end].tolist(), first, starts, ends, items)
        return starts, ends, items

    def _stream(self, codes: list[int], first: int, starts: list, ends: list, items: set) -> None:
        nxt, link, length, shortest, window = self.next, self.link, self.length, self.shortest, self.window
        s = matched = 0
        for i, w in enumerate(codes, first + 1):
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                matched = length[s]
                t = nxt[s].get(w)
            if t is None:
                continue
            s = t
            matched += 1
            if matched < shortest:
                continue
            reach = 0
            if matched >= window:
                reach = window
                items |= self.window_items[self.window_state[s]]
            for k, item_id in self.short_items.get(s, ()):
                if k <= matched:
                    reach = max(reach, k)
                    items.add(item_id)
            if reach:
                begin = i - reach
                while starts and starts[-1] >= begin:
                    starts.pop()
                    ends.pop()
                if starts and ends[-1] >= begin:
                    ends[-1] = i
                else:
                    starts.append(begin)
                    ends.append(i)


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hit", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with a struct column ``out``: number of words, merged spans of hit words, items found."""
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col("text"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), body.alias("text"))
    # An upper bound of an item's words is half its bytes.
    items = items.withColumn("words", F.floor(F.octet_length("text") / 2) + 1)
    total = items.agg(F.sum("words")).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / block_words)) if total > block_words else 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))

    def scan(b: int) -> Column:
        chosen = items.where(block == b) if blocks > 1 else items
        rows = [(r.item_id, r.text.encode()) for r in chosen.select("item_id", "text").collect()]
        return _scan(spark.sparkContext.broadcast(Automaton.build(rows, WINDOW)))(F.col(text))

    found = docs.withColumn(out, scan(0))
    if blocks == 1:
        return found
    # The documents are written once; every further block reads their texts and writes its hits only.
    key = "_row"
    while any(c.startswith(key) for c in found.columns):
        key += "_"
    stored = materialise(found.withColumn(key, F.monotonically_increasing_id()), "decontaminate")
    hits = [
        materialise(stored.select(key, scan(b).alias("more")).where(F.size("more.starts") > 0), "decontaminate-hits")
        for b in range(1, blocks)
    ]
    listed = f"{key}_more"
    more = reduce(DataFrame.unionByName, hits).groupBy(key).agg(F.collect_list("more").alias(listed))
    nothing = F.array().cast(f"array<{HIT_TYPE}>")
    whole = F.aggregate(F.coalesce(listed, nothing), F.col(out), _merged)
    return stored.join(more, key, "left").withColumn(out, whole).select(*found.columns)


def _scan(shared):
    def scan(texts: pa.Array) -> pa.Array:
        automaton = shared.value
        n_words, starts, ends, items = [], [], [], []
        for text in texts.cast(pa.large_binary()):
            words = words_of(text.as_py() or b"")
            s, e, found = automaton.scan(words)
            n_words.append(len(words))
            starts.append(s)
            ends.append(e)
            items.append(sorted(x for x in found if x is not None))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends, items)]
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), *lists], names=["n_words", "starts", "ends", "items"]
        )

    # Dear and, with its broadcast, not to be run twice for a filter and a projection.
    return F.arrow_udf(scan, HIT_TYPE).asNondeterministic()


def _merged(a: Column, b: Column) -> Column:
    """Spans of two blocks, merged in order of their starts."""
    spans = F.array_sort(F.concat(F.arrays_zip(a.starts, a.ends), F.arrays_zip(b.starts, b.ends)))
    empty = F.slice(spans, 1, 0)

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["0"].alias("0"), F.greatest(last["1"], span["1"]).alias("1"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        apart = (F.size(done) == 0) | (last["1"] < span["0"])
        return F.when(apart, F.concat(done, F.array(span))).otherwise(joined)

    zipped = F.transform(spans, lambda s: F.struct(s["starts"].alias("0"), s["ends"].alias("1")))
    zipped_empty = F.transform(empty, lambda s: F.struct(s["starts"].alias("0"), s["ends"].alias("1")))
    union = F.aggregate(zipped, zipped_empty, lambda done, s: F.when(F.size(done) == 0, F.array(s)).otherwise(add(done, s)))
    return F.struct(
        a.n_words.alias("n_words"),
        F.transform(union, lambda s: s["0"]).alias("starts"),
        F.transform(union, lambda s: s["1"]).alias("ends"),
        F.array_union(a["items"], b["items"]).alias("items"),
    )


def hit_words(hit: Column) -> Column:
    pairs = F.zip_with(hit.starts, hit.ends, lambda s, e: e - s)
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x)


def contaminated(hit: Column, one_in: int = 20) -> Column:
    """Any word hit, and at least one word in ``one_in``."""
    n = hit_words(hit)
    return (n > 0) & (n * one_in >= hit.n_words)


def remove_spans(text: Column, hit: Column, min_words: int = WINDOW) -> Column:
    """The text without hit spans of at least ``min_words`` words, separators inside included."""

    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        out = []
        for t, s, e in zip(texts.cast(pa.large_binary()).to_pylist(), starts.to_pylist(), ends.to_pylist()):
            spans = [(a, b) for a, b in zip(s or (), e or ()) if b - a >= min_words]
            if t is not None and spans:
                at = [m.span() for m in word.finditer(t)]
                pieces, done = [], 0
                for a, b in spans:
                    pieces.append(t[done : at[a][0]])
                    done = at[b - 1][1]
                t = b"".join([*pieces, t[done:]])
            out.append(None if t is None else t.decode())
        return pa.array(out, pa.string())

    return F.arrow_udf(cut, "string")(text, hit.starts, hit.ends)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row of counts and the verdict for each document."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark)
    hit = F.col("hit")
    listed = F.array_join(F.array_sort(F.transform(hit["items"], lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        hit.n_words.alias("n_words"),
        hit_words(hit).alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        contaminated(hit).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns and texts."""
    mark = "_hit"
    while mark in docs.columns:
        mark += "_"
    found = find_benchmark(docs, benchmark, out=mark)
    return found.where(~contaminated(F.col(mark))).select(*[F.col(f"`{c}`") for c in docs.columns])
