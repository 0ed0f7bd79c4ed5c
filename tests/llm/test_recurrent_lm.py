"""The language model against brute force, numeric gradients and held-out texts."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import recurrent_lm as lm


def lexicon(texts):
    counts = Counter(w for t in texts for w in t)
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm.KNOWN]
    tokens, distinct = np.zeros(lm.TAILS, np.int64), np.zeros(lm.TAILS, np.int64)
    for w, n in list(counts.items()):
        if w not in dict(top[: lm.HEAD - 1]):
            tail = int.from_bytes(w.encode()[-2:], "big") % lm.TAILS
            tokens[tail] += n
            distinct[tail] += 1
    total = sum(counts.values()) + len(texts)
    return lm.Lexicon([w for w, _ in top], np.array([n for _, n in top]), total, len(counts) + 1, len(texts), tokens, distinct)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    texts = [[f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(80))] for _ in range(50)]
    lex = lexicon(texts)
    return lex, lm.Network.start(lex), [lex.texts(lex.ids(pa.array(t, pa.string())), [len(t)])[0] for t in texts]


def test_probabilities_sum_to_one(model):
    _, network, _ = model
    h = np.random.default_rng(0).normal(0, 1, (3, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.HEAD + lm.TAILS)
    for row in h:
        assert abs(np.exp(network.predict(np.tile(row, (len(every), 1)), every)[0]).sum() - 1) < 1e-3


def test_state_crosses_windows(model, monkeypatch):
    """The same scores whatever the windows and lanes; text by text as well."""
    _, network, texts = model
    whole = lm.log_likelihood(network, texts)
    alone = np.concatenate([lm.log_likelihood(network, [t]) for t in texts])
    monkeypatch.setattr(lm, "SCORE_WINDOW", 3)
    monkeypatch.setattr(lm, "SCORE_LANES", 2)
    assert np.allclose(whole, alone, atol=1e-4) and np.allclose(whole, lm.log_likelihood(network, texts), atol=1e-4)


def test_gradients_against_differences(model, monkeypatch):
    """One step of ``learn`` moves every parameter by its numeric derivative."""
    _, start, texts = model
    read, target, place = next(lm._windows(texts[:6], 4, 5))
    used = place >= 0
    h = np.random.default_rng(2).normal(0, 0.5, (lm.HIDDEN, read.shape[1]))
    exact = lm.Network({k: v.astype(np.float64) for k, v in start.values.items()}, {})

    def loss():
        out, _ = exact.states(read, h)
        return -exact.predict(out[used].astype(np.float64), target[used])[0].sum()

    moved = lm.Network({k: v.copy() for k, v in start.values.items()}, {k: np.zeros_like(v) for k, v in start.values.items()})
    monkeypatch.setattr(lm, "RATE", 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        moved.learn(read, target, used, h.astype(np.float32))
    rng = np.random.default_rng(3)
    for name, squares in moved.squares.items():
        for at in rng.permutation(np.argwhere(squares > squares.max() / 100))[:3]:
            at = tuple(at)
            value = exact.values[name][at]
            sides = []
            for step in (1e-2, -1e-2):
                exact.values[name][at] = value + step
                sides.append(loss())
            exact.values[name][at] = value
            slope = (sides[0] - sides[1]) / 2e-2
            assert abs(abs(slope) - math.sqrt(squares[at])) < 2e-2 * abs(slope) + 2e-2, (name, at)


def brute_base(docs):
    held = {i: crc32(str(i).encode()) % 10 == 0 for i in docs}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total = sum(counts.values())
    down = math.log10(total + 0.1 * (len(counts) + 1))
    return {
        i: (held[i], len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10(counts[w] + 0.1) - down for w in t))
        for i, t in tokens.items()
    }


@pytest.mark.parametrize("known", [200_000, 500])
def test_base_score_against_brute_force(spark, small, monkeypatch, known):
    """With all counts broadcast, and with most of them joined."""
    monkeypatch.setattr(lm, "KNOWN", known)
    monkeypatch.setattr(lm, "MOST_PASSES", 1)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = lm.language_scores(docs).collect()
    want = brute_base(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
        assert r.score < 0


def test_held_out_texts_are_predicted_better_than_by_counts(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["op13_lm_score"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    gain = (sum(r.score for r in rows) - sum(r.base_score for r in rows)) / tokens
    assert gain > 0.15  # decimal digits a token
    assert sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b " * 30_000), (3, "a B " * 30_000), (None, "a \x0b é"), (4, "漢字 🙂"), (11, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'w' AS word", "2 AS n", "3 AS held_out", "4 AS part")
    found = sorted((r.doc_id or 0, r.n_tokens, r.held_out) for r in lm.language_scores(docs.repartition(3)).collect())
    assert [(i, n) for i, n, _ in found] == [(0, 3), (1, 1), (2, 1), (3, 60_001), (3, 60_001), (4, 3), (11, 2)]
    assert not found[0][2]
    assert lm.language_scores(docs.limit(0)).count() == 0
    unseen = lm.language_scores(docs.filter("doc_id IS NULL")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in unseen] == [(0, 0, 0.0)] and math.isfinite(unseen[0].score)


def test_tail_classes_agree_between_python_and_spark(spark):
    from pyspark.sql import functions as F

    words = ["a", "é", "ab", "naïve", "漢", "tion.", "🙂"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", lm.tail_column(F.col("w")).alias("t")).collect()
    assert [r.t for r in rows] == lm.tails_of(pa.array([r.w for r in rows])).tolist()
    assert [r.t for r in rows] == [int.from_bytes(r.w.encode()[-2:], "big") % lm.TAILS for r in rows]


def test_words_are_those_of_the_contract():
    texts = [" A b\x0b\tÉ ", None, "", "\x0c", "x", "é\u00a0y\u2003Z"]
    words, sizes = lm.words_of(pa.array(texts))
    assert words.to_pylist() == ["a", "b", "É", "x", "é\u00a0y\u2003z"] and sizes.tolist() == [3, 0, 0, 0, 1, 1]
    sliced = lm.words_of(pa.array(["q q", *texts]).slice(1))
    assert sliced[0].equals(words) and sliced[1].tolist() == sizes.tolist()
    assert lm.tails_of(words).tolist() == [int.from_bytes(w.encode()[-2:], "big") % lm.TAILS for w in words.to_pylist()]
