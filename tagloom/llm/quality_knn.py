"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are pairs of neighbouring bytes (digits alike), lower-case words, and words that follow
themselves, hashed into a fixed number of columns. A bounded sample of labelled documents gives the term weights, and a truncated
singular value decomposition of their weighted matrix gives the latent space. The labelled vectors
and the projection are broadcast (their size is fixed by the parameters). Every document is
projected, its cosines to all labelled vectors are computed in blocks, and the most similar
``NEIGHBOURS`` vote with their labels, weighted by similarity and by how many labelled rows of its label
a neighbour stands for, so the sample's bound on each label does not shift the odds of the labels.

The sample: at most ``SAMPLE`` labelled rows of each label, those with the smallest hashes of
``doc_id``; rows whose ``crc32(doc_id) mod 3`` is 1 are never learnt from.

Defined results: a null or empty text, or one without known terms, has no direction and scores the
share of label 1 in the labelled table; without any usable label every score is 0.5 (predicted 1); null
labels are ignored; several labels of one document are several neighbours; of equally similar
neighbours the one earlier in ``(doc_id, label)`` order votes; repeated rows score alike; all columns of
the documents are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import ship

SAMPLE = 1500
PAIR_TERMS, WORD_TERMS, REPEAT_TERMS = 4096, 4096, 64
REPEAT_WEIGHT = 4.0  # few columns stand for all words that follow themselves
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 8.0  # votes weigh similarity to this power
BLOCK = 256
MEMO = 120_000  # words remembered by a worker

TERMS = PAIR_TERMS + WORD_TERMS + REPEAT_TERMS
DIGITS_ALIKE = bytes(48 if 48 <= b <= 57 else b for b in range(256))


@dataclass
class Model:
    weights: np.ndarray  # of terms
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled documents x rank, unit length
    labels: np.ndarray
    stands_for: np.ndarray  # labelled rows of its label per sampled row
    prior: float


@cache
def _word_terms() -> dict[bytes, int]:
    return {}


def term_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of the terms of one text."""
    codes = np.frombuffer(text.translate(DIGITS_ALIKE), np.uint8).astype(np.uint32)
    pairs = ((codes[:-1] * 256 + codes[1:]) * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.bincount(pairs, minlength=TERMS).astype(np.float32)
    known = _word_terms()
    if len(known) > MEMO:
        known.clear()
    words = text.lower().split()
    terms = list(map(known.get, words))
    if None in terms:
        for w in words:
            if w not in known:
                known[w] = PAIR_TERMS + crc32(w) % WORD_TERMS
        terms = list(map(known.__getitem__, words))
    if terms:
        columns = np.asarray(terms)
        again = columns[1:][columns[1:] == columns[:-1]]
        counts += np.bincount(columns, minlength=TERMS)
        counts += np.bincount(PAIR_TERMS + WORD_TERMS + again % REPEAT_TERMS, minlength=TERMS)
    columns = np.flatnonzero(counts)
    return columns, counts[columns]


def _dampened(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from labelled documents; the driver holds the bounded sample only."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").cast("int"))
    shares = usable.groupBy("quality").count().collect()
    total = sum(r["count"] for r in shares)
    prior = sum(r["count"] for r in shares if r["quality"] == 1) / total if total else 0.5
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [usable.where(F.col("quality") == q).orderBy(*order).limit(SAMPLE) for q in (0, 1)]
    # At most 2 * SAMPLE narrow rows, so this side is safe to broadcast.
    chosen = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    rows = rows.select("doc_id", "quality", _sample_terms()(F.col("text")).alias("terms"))
    sample = rows.dropDuplicates(["doc_id", "quality"]).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["quality"]))
    matrix = np.zeros((len(sample), TERMS), np.float32)
    for i, r in enumerate(sample):
        columns, counts = np.frombuffer(r["terms"], np.float32).reshape(2, -1)
        matrix[i, columns.astype(np.int64)] = _dampened(counts)
    picked_labels = np.asarray([r["quality"] for r in sample], np.int64)
    whole = np.zeros(2)
    for r in shares:
        whole[r["quality"]] = r["count"]
    stands_for = (whole / np.maximum(np.bincount(picked_labels, minlength=2), 1))[picked_labels]
    return _decompose(matrix, picked_labels.astype(np.float32), stands_for, prior)


def _sample_terms():
    def terms(texts: pa.Array) -> pa.Array:
        found = (term_counts(t.as_py()) for t in texts.cast(pa.large_binary()))
        return pa.array([np.concatenate(f).astype(np.float32).tobytes() for f in found], pa.binary())

    return F.arrow_udf(terms, "binary")


def _decompose(matrix: np.ndarray, labels: np.ndarray, stands_for: np.ndarray, prior: float) -> Model:
    n = len(matrix)
    if not n:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, stands_for, prior)
    weights = np.log((1 + n) / (1 + (matrix > 0).sum(0))).astype(np.float32) + 0.1
    weights[PAIR_TERMS + WORD_TERMS :] *= REPEAT_WEIGHT
    matrix *= weights
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    # Randomised range finder with power steps; the seed is fixed.
    rank = min(RANK, n)
    probe = np.random.default_rng(0).standard_normal((TERMS, min(n, rank + 16))).astype(np.float32)
    basis = np.linalg.qr(matrix @ probe)[0]
    for _ in range(3):
        basis = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ basis)[0])[0]
    axes = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:rank].T.astype(np.float32)
    vectors = _unit(matrix @ axes)
    return Model(weights, np.ascontiguousarray(axes), vectors, labels, stands_for, prior)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def vote(model: Model, texts: list[bytes]) -> np.ndarray:
    """Scores of a block of texts."""
    scores = np.full(len(texts), model.prior)
    if not len(model.vectors):
        return scores
    rows = np.zeros((len(texts), model.axes.shape[1]), np.float32)
    for i, text in enumerate(texts):
        if text:
            columns, counts = term_counts(text)
            rows[i] = (_dampened(counts) * model.weights[columns]) @ model.axes[columns]
    known = np.flatnonzero(np.linalg.norm(rows, axis=1) > 1e-6)
    cosines = _unit(rows[known]) @ model.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    if k < cosines.shape[1]:
        limit = np.partition(cosines, -k, axis=1)[:, -k][:, None]
        above = cosines > limit
        tied = cosines == limit
        room = k - above.sum(1, keepdims=True)
        voting = above | (tied & (np.cumsum(tied, axis=1) <= room))
    else:
        voting = np.ones_like(cosines, bool)
    weight = np.where(voting, np.maximum(cosines, 0) ** SHARPNESS, 0).astype(np.float64) * model.stands_for
    sums = weight.sum(1)
    scores[known] = np.where(sums > 0, (weight @ model.labels) / np.where(sums > 0, sums, 1), model.prior)
    return scores


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score of each row's text; row-local."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        values = texts.cast(pa.large_binary())
        blocks = [vote(shared.value, values.slice(i, BLOCK).to_pylist()) for i in range(0, len(values), BLOCK)]
        return pa.array(np.concatenate(blocks) if blocks else np.empty(0), pa.float64())

    return F.arrow_udf(score, "double").asNondeterministic()(F.col(text))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model:
    ship(docs.sparkSession)
    return fit(docs, labels)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    model = fit_quality(docs, labels)
    scored = docs.select("doc_id", score_column(docs, model).alias("score"))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be of quality, with their own columns."""
    model = fit_quality(docs, labels)
    mark = "_score"
    while mark in docs.columns:
        mark += "_"
    scored = docs.withColumn(mark, score_column(docs, model))
    return scored.where(F.col(mark) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
