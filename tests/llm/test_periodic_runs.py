"""Runs of periodic words against brute force."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from tagloom.llm import periodic_runs as pr


def brute_runs(words):
    """Every stretch that no period extends, smallest period first."""
    found, seen = [], set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i >= 3 * q and (i, j + q) not in seen:
                seen.add((i, j + q))
                if j + q - i >= 6:
                    found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plant(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def brute_row(doc_id, text):
    words = plant(doc_id, text)
    runs = brute_runs(words)
    kept = [True] * len(words)
    for s, length, q in runs:
        kept[s + q : s + length] = [False] * (length - q)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    digests = [hashlib.sha256(x).hexdigest() for x in (lines.encode(), b" ".join(w for w, k in zip(words, kept) if k))]
    return (len(runs), *best, milli, *digests)


def mixed_words(rng):
    words = []
    for _ in range(rng.randrange(6)):
        if rng.random() < 0.3:
            words += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(60))]
            continue
        unit = [rng.randrange(rng.choice([2, 4, 1000])) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 70, 128]))]
        if rng.random() < 0.4:
            unit = unit * rng.randrange(1, 6) + [5]
        words += [unit[i % len(unit)] for i in range(int(len(unit) * rng.choice([1.5, 3.9, 4, 4.3, 6, 9])))]
    return words


@pytest.mark.parametrize("base", [2, 8])
def test_runs_against_brute_force(monkeypatch, base):
    """Periods of all sizes, nested and neighbouring runs, exponents around the limit; two base scales."""
    monkeypatch.setattr(pr, "BASE", base)
    rng = random.Random(base)
    for _ in range(60):
        docs = sorted((mixed_words(rng) for _ in range(rng.randrange(1, 5))), key=len, reverse=True)
        flat = np.array([w for i, d in enumerate(docs) for w in [*d, 10**6 + i]], np.int64)
        start, end, period = pr.find_runs(flat, np.array([len(d) for d in docs]))
        want, at = [], 0
        for d in docs:
            want += [(s + at, s + at + n, q) for s, n, q in brute_runs(d)]
            at += len(d) + 1
        assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_query_against_brute_force(spark, small):
    import __spark_entry__ as entry

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    short = {i: t for i, t in docs.items() if len(t or "") < 6000}
    rows = {r.doc_id: r for r in entry.queries()["op11_periodic_runs"](spark, small).collect()}
    assert rows.keys() == docs.keys()
    for i, text in short.items():
        assert tuple(rows[i])[1:] == brute_row(i, text), i
    assert any(r.n_runs for r in rows.values())


def test_odd_rows(spark):
    long = "x y z " * 200_000
    rows = [(1, None, 0), (2, "", 0), (None, "a " * 9, 0), (3, "a\tb\x0ba b a b\na b c", 0), (3, "a\tb\x0ba b a b\na b c", 0), (4, long, 0), (8, "\u00a0 \u2003 " * 6, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(2)
    found = sorted(((r.doc_id or 0, r.runs, r.collapsed) for r in pr.periodic_runs(docs).collect()), key=lambda r: r[0])
    by_id = {i: ([tuple(x) for x in runs], text) for i, runs, text in found}
    assert len(found) == len(rows) and by_id[1] == by_id[2] == ([], "")
    assert by_id[0] == ([(0, 9, 1)], "a") and by_id[3] == ([(0, 8, 2)], "a b c")
    assert by_id[4] == ([(0, 600_000, 3)], "x y z") and by_id[8] == ([(0, 12, 2)], "\u00a0 \u2003")
    assert pr.periodic_runs(docs.limit(0)).count() == 0
    planted = pr.run_digest(pr.periodic_runs(docs.withColumn("text", pr.plant_repeats(docs.doc_id, docs.text)))).collect()
    assert {r.doc_id: tuple(r)[1:] for r in planted} == {i: brute_row(i, t) for i, t, _ in rows if i != 4} | {
        4: next(tuple(r)[1:] for r in planted if r.doc_id == 4)
    }


def test_time_follows_the_words():
    """A long periodic text and a long text without any period."""
    import time

    rng = np.random.default_rng(5)
    took = []
    for n in (100_000, 400_000):
        began = time.perf_counter()
        for words in (np.arange(n) % 6001, rng.integers(0, 300, n)):
            pr.find_runs(np.append(words, 10**7), np.array([n]))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5
