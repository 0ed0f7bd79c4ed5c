"""TF-IDF with binary term frequency, smoothed idf and unit-length rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.arrays import elements
from tagloom.operators.profile import WORD_REGEX
from tagloom.operators.topk import top_n
from tagloom.session import materialise

# Fixed value: terms kept per corpus.
MAX_FEATURES = 25_000

# Vocabularies of up to this many bytes of terms are looked up inside rows; larger ones are joined.
BROADCAST_BYTES = 32 << 20
TERM_OVERHEAD = 100


def noun_text(nouns: Column) -> Column:
    return F.array_join(nouns, " ")


def terms(text: Column) -> Column:
    """Distinct lower-case words of at least two characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_REGEX), F.lit(0)))


def noun_terms(nouns: Column) -> Column:
    """The terms of ``noun_text(nouns)``; repeated nouns add none, so they are dropped before any pattern is matched."""
    return terms(noun_text(F.array_distinct(nouns)))


def vocabulary(docs: DataFrame, max_features: int = MAX_FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """``term, df, idf`` of the ``max_features`` terms with the highest document frequency.

    ``docs`` has an array column ``terms``. With ``by`` there is one vocabulary per group. Each
    document counts a term once by construction, so no distinct over (document, term) is needed.
    """
    counts = (
        elements(docs, by, F.col("terms"), "term")
        .groupBy(*by, "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    top = top_n(counts, max_features, [F.col("df").desc(), F.col("term")], ["term"], group=by)
    if by:
        sizes = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        top = top.join(sizes, list(by))
        n_docs = F.col("_n")
    else:
        n_docs = docs.agg(F.count(F.lit(1))).scalar()
    idf = F.ln((n_docs + 1) / (F.col("df") + 1)) + 1
    return top.select(*by, "term", "df", idf.alias("idf"))


def fits_in_rows(vocab: DataFrame) -> bool:
    size = vocab.agg(F.sum(F.octet_length("term") + TERM_OVERHEAD)).first()[0] or 0
    return size <= BROADCAST_BYTES


def weights(docs: DataFrame, vocab: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``doc_id, term, weight`` for every kept term; each document has unit length.

    ``vocab`` should be a stored table. If its terms fit the bound they are looked up inside the row,
    which also gives the norm, and nothing is shuffled. Otherwise documents are shuffled once, as
    compact term arrays, and the norm reuses that partitioning.
    """
    keys = [*by, "doc_id"]
    kept = vocab.select(*by, "term", "idf")
    if fits_in_rows(vocab):
        tables: dict[tuple, dict[str, float]] = {}
        for r in kept.collect():
            tables.setdefault(tuple(r[c] for c in by), {})[r["term"]] = r["idf"]
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def weigh(found: pa.Array, *groups: pa.Array) -> pa.Array:
            # One look-up per distinct term and group of the batch; everything else is arithmetic on columns.
            sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            coded = found.flatten().dictionary_encode()
            words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            keys = list(zip(*(g.to_pylist() for g in groups))) if groups else [()] * len(found)
            place = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            idf = np.zeros((len(place), max(len(words), 1)))
            for key, i in place.items():
                get = shared.value.get(key, {}).get
                idf[i, : len(words)] = [get(w, 0.0) for w in words]
            rows = np.repeat(np.arange(len(sizes)), sizes)
            own = idf[np.fromiter(map(place.get, keys), np.int64, len(keys))[rows], codes] if len(codes) else np.empty(0)
            norm = np.sqrt(np.bincount(rows, own * own, len(sizes)))
            kept = np.flatnonzero(own > 0)  # every idf is at least 1
            offsets = np.concatenate(([0], np.cumsum(np.bincount(rows[kept], minlength=len(sizes)))))
            parts = [coded.take(pa.array(kept)).cast(pa.string()), pa.array(own[kept] / norm[rows[kept]])]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["term", "weight"]))

        weigh = F.arrow_udf(weigh, "array<struct<term: string, weight: double>>").asNondeterministic()
        rows = docs.withColumn("_w", weigh("terms", *by)).select(*keys, F.explode("_w").alias("_w"))
        return rows.select(*keys, "_w.term", "_w.weight")
    spread = docs.select(*keys, "terms").repartition("doc_id")
    hits = elements(spread, keys, F.col("terms"), "term").join(kept, [*by, "term"])
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy(*keys)))
    return hits.select(*keys, "term", (F.col("idf") / norm).alias("weight"))


def projected(docs: DataFrame, entries: list, axes) -> DataFrame:
    """``doc_id, point`` of every document: its TF-IDF row times two axes, which follow ``entries``.

    Row-local; a document without any kept term is at the origin.
    """
    table = {e["term"]: i for i, e in enumerate(entries, 1)}
    idf = np.array([0.0, *[e["idf"] for e in entries]])
    shared = docs.sparkSession.sparkContext.broadcast((table, idf, np.vstack([np.zeros((1, 2)), axes])))

    def place(found: pa.Array) -> pa.Array:
        # One look-up per distinct term of the batch; number 0 stands for terms that are not kept.
        table, idf, axes = shared.value
        sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
        coded = found.flatten().dictionary_encode()
        numbers = np.array([table.get(w, 0) for w in coded.dictionary.to_pylist()] or [0])
        entry = numbers[pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        own = idf[entry]
        norm = np.sqrt(np.bincount(rows, own * own, len(sizes)))
        norm[norm == 0] = 1.0
        sums = np.column_stack([np.bincount(rows, own * axes[entry, i], len(sizes)) / norm for i in (0, 1)])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(sizes) + 1, 2), pa.int32()), pa.array(sums.ravel()))

    return docs.select("doc_id", F.arrow_udf(place, "array<double>")("terms").alias("point"))


def term_documents(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    return docs.select(*keep, terms(text).alias("terms"))


def tfidf(docs: DataFrame, max_features: int = MAX_FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """Long TF-IDF of ``doc_id, nouns``; with ``by``, of every group in one job.

    The term arrays are written once: vocabulary, document count and weights all read them.
    """
    prepared = materialise(docs.select(*by, "doc_id", noun_terms(F.col("nouns")).alias("terms")), "terms")
    return weights(prepared, materialise(vocabulary(prepared, max_features, by), "vocabulary"), by)


def vocabulary_entries(vocab: DataFrame) -> list:
    """Terms with their idf, in the order of vector positions; a model of checked size."""
    if not fits_in_rows(vocab):
        raise ValueError(f"the terms exceed {BROADCAST_BYTES} bytes; choose fewer features")
    return vocab.orderBy(F.col("df").desc(), "term").select("term", "idf").collect()


def tfidf_vectors(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``doc_id, features``: the same weights as sparse vectors, one narrow pass.

    ``vocab`` (one group, bounded by ``max_features``) becomes the model.
    """
    entries = vocabulary_entries(vocab)
    counter = CountVectorizerModel.from_vocabulary(
        [e["term"] for e in entries], inputCol="terms", outputCol="_binary"
    ).setBinary(True).setMinTF(0.0)
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([e["idf"] for e in entries]), inputCol="_binary", outputCol="_scaled"
    )
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol="features")
    frame = docs.select("doc_id", "terms")
    for stage in (counter, scale, unit):
        frame = stage.transform(frame)
    return frame.select("doc_id", "features")
