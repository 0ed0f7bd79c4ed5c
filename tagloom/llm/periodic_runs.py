"""Periodic runs by string synchronising sets.

A run is a longest stretch of words with smallest period ``q`` that holds at least ``EXPONENT`` periods.
At every dyadic scale ``t`` hashes select positions that depend only on the ``2t`` words after them: a
position is selected if its ``t``-word window has the least hash among the next ``t + 1`` windows, or
the last of them has. Any ``t`` neighbouring windows hold a selected one unless all of them are highly
periodic (period at most ``t / EXPONENT``). In a run of period ``q``, ``t <= q < 2t``, a position in
the first ``t`` words is therefore selected, and so is the one ``q`` words on, the next with an equal
context: the pair proposes the period, and words are compared to extend it. Highly periodic windows are
left out of the selection; they are the runs found at smaller scales, and the smallest periods, below
``BASE``, are detected directly. Hashes only propose, so results are exact.

The documents of a slice are joined with separators that never repeat, the longest first, so that each
scale works on the documents that are long enough for it in one go.

Defined results: a null text has no words; repeated rows are treated alike; a row with a null
``doc_id`` has no planted repeats; an empty table gives no rows; other columns are ignored. A text may
have any length; a slice holds one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.arrays import let, positions
from tagloom.llm.workers import ship

EXPONENT = 4  # periods that a run holds at least
SHORTEST = 6  # words that a run holds at least
BASE = 8  # scale of the first synchronising set, a power of two; smaller periods are found directly
SLICE_BYTES = 4 << 20
WORDS = r"[^\x20\x09-\x0D]+"
RUN = "struct<start: bigint, length: bigint, period: bigint>"
FOUND = f"doc_id string, runs array<{RUN}>, collapsed string"

NO_HASH = np.iinfo(np.uint64).max
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows from the hashes of their halves."""
    return _scatter(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width + 1`` neighbours; ``width`` is a power of two."""
    low, done = hashes, 1
    while done < width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    return np.minimum(low[:-1], low[1:])


def _direct(words: np.ndarray, period: int) -> Runs:
    """All stretches of ``period`` that are long enough, whatever their smallest period."""
    same = np.zeros(max(len(words) - period, 0) + 2, np.int8)
    if len(words) > period:
        same[1:-1] = words[:-period] == words[period:]
    edges = np.flatnonzero(np.diff(same))
    start, end = edges[::2], edges[1::2] + period
    long = end - start >= EXPONENT * period
    return start[long], end[long], np.full(int(long.sum()), period)


def _selected(hashes: np.ndarray, scale: int, runs: Runs) -> np.ndarray:
    """The synchronising set: positions chosen by the hashes of windows that are not highly periodic."""
    start, end, period = runs
    inside = (end - start >= scale) & (EXPONENT * period <= scale) & (start < len(hashes))
    if inside.any():
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, start[inside], 1)
        np.add.at(cover, np.minimum(end[inside] - scale + 1, len(hashes)), -1)
        hashes = np.where(np.cumsum(cover[:-1]) > 0, NO_HASH, hashes)
    least = _least(hashes, scale)
    return np.flatnonzero((least != NO_HASH) & ((least == hashes[:-scale]) | (least == hashes[scale:])))


def _reach(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, in the direction of ``step``, equal those ``period`` further right."""
    done, width = 0, 64
    most = len(words) - period - at if step > 0 else at + 1
    while done < most:
        width = min(width, most - done)
        low = at + done if step > 0 else at - done - width + 1
        differ = words[low : low + width] != words[low + period : low + period + width]
        if differ.any():
            return done + int(np.argmax(differ if step > 0 else differ[::-1]))
        done += width
        width *= 2
    return most


def _proposed(words: np.ndarray, hashes: np.ndarray, contexts: np.ndarray, scale: int, runs: Runs) -> Iterator[tuple]:
    """Maximal stretches of the periods that neighbouring equal contexts propose."""
    chosen = _selected(hashes, scale, runs)
    order = np.argsort(contexts[chosen], kind="stable")
    at, key = chosen[order], contexts[chosen[order]]
    gap = np.diff(at)
    good = np.flatnonzero((key[1:] == key[:-1]) & (gap >= scale) & (gap < 2 * scale))
    covered: dict[int, int] = {}  # by period, the end of the last stretch
    by_place = good[np.argsort(at[good], kind="stable")]
    for i, period in zip(at[by_place].tolist(), gap[by_place].tolist()):
        if i + period < covered.get(period, 0):
            continue
        start = i + 1 - _reach(words, i, period, -1)
        end = i + period + _reach(words, i, period, 1)
        covered[period] = end
        if end - start >= EXPONENT * period:
            yield start, end, period


def find_runs(words: np.ndarray, sizes: np.ndarray) -> Runs:
    """Starts, ends and smallest periods of the runs in documents laid end to end.

    ``sizes`` counts the words of each, largest first; each is followed by a word found nowhere else.
    """
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)))

    def part(scale: int) -> int:
        """Where the documents end that can hold a run with a period of ``scale``."""
        return int(firsts[np.count_nonzero(sizes >= EXPONENT * scale)])

    runs: Runs = tuple(np.empty(0, np.int64) for _ in range(3))
    taken = np.empty(0, np.int64)  # (start, end) as one number: a stretch keeps its smallest period
    span = len(words) + 1

    def add(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        nonlocal runs, taken
        places = start * span + end
        new = ~np.isin(places, taken)
        runs = tuple(np.concatenate((a, b[new])) for a, b in zip(runs, (start, end, period)))
        taken = np.concatenate((taken, places[new]))

    for period in range(1, BASE):
        add(*_direct(words[: part(period)], period))
    hashes, width = _scatter(words[: part(BASE)].astype(np.uint64) + np.uint64(1)), 1
    while part(width if width >= BASE else BASE):
        doubled = _joined(hashes[:-width], hashes[width:])
        if width >= BASE:
            own = words[: part(width)]
            found = list(_proposed(own, hashes, doubled, width, runs))
            if found:
                add(*np.array(sorted(found, key=lambda r: r[2]), np.int64).T)
        width *= 2
        hashes = doubled[: max(part(max(width, BASE)) - width + 1, 0)]
    start, end, period = runs
    kept = end - start >= SHORTEST
    order = np.lexsort((period[kept], start[kept]))
    return start[kept][order], end[kept][order], period[kept][order]


def _examined(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [(t or "").encode().split() for t in batch["text"].to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-sizes, kind="stable")
    flat = pa.array([w for d in order for w in texts[d]], pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.concatenate(([0], np.cumsum(sizes[order] + 1)))
    words = np.empty(int(firsts[-1]), np.int64)
    ends = firsts[1:] - 1
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = codes
    words[ends] = len(flat) + np.arange(len(ends))
    start, end, period = find_runs(words, sizes[order])
    owner = np.searchsorted(firsts, start, "right") - 1
    runs: list[list] = [[] for _ in texts]
    for d, s, e, q in zip(order[owner].tolist(), (start - firsts[owner]).tolist(), (end - firsts[owner]).tolist(), period.tolist()):
        runs[d].append({"start": s, "length": e - s, "period": q})
    collapsed = []
    for own, found in zip(texts, runs):
        if found:
            kept = np.ones(len(own), bool)
            for r in found:
                kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
            own = [own[i] for i in np.flatnonzero(kept).tolist()]
        collapsed.append(b" ".join(own).decode())
    kinds = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    columns = [batch["doc_id"], pa.array(runs, pa.list_(kinds)), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    first, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > first and held + n > SLICE_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield batch.slice(first)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed``: every run, and the text without the repeats of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(_examined, _slices(batch))

    ship(docs.sparkSession)
    kind = docs.select("doc_id").dtypes[0][1]
    return docs.select("doc_id", "text").mapInArrow(run, FOUND.replace("doc_id string", f"doc_id {kind}"))


def plant_repeats(doc_id: Column, text: Column) -> Column:
    """The text, for a tenth of the ids with a periodic tail; words of such texts are joined by one space."""
    drawn = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(drawn / 10).cast("bigint")

    def planted(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        moved = F.transform(
            positions(F.size(words)),
            lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")),
        )
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(F.lit(""))

    due = F.coalesce(drawn % 10 == 0, F.lit(False)) & text.isNotNull()
    return F.when(due, let(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), planted)).otherwise(text)


def run_digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.col3")).cast("bigint").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
