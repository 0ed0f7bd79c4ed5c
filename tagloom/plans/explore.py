"""From noun documents to silhouettes of a k-means sweep."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.cluster import SWEEP, kmeans_labels, svd_axes
from tagloom.operators.silhouette import silhouette_exact, silhouette_squared
from tagloom.operators.tfidf import (
    MAX_FEATURES,
    noun_terms,
    projected,
    tfidf_vectors,
    vocabulary,
    vocabulary_entries,
)
from tagloom.session import materialise
from tagloom.sources.tables import ANALYZERS


def documents_2d(docs: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``doc_id, point`` of every row of ``doc_id, nouns``."""
    return _terms_2d(materialise(docs.select("doc_id", noun_terms(F.col("nouns")).alias("terms")), "terms"), max_features)


def _terms_2d(terms: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    vocab = materialise(vocabulary(terms, max_features), "vocabulary")
    entries = vocabulary_entries(vocab)
    if not entries:
        return terms.select("doc_id", F.array(F.lit(0.0), F.lit(0.0)).alias("point"))
    return projected(terms, entries, svd_axes(tfidf_vectors(terms, vocab), len(entries)))


def sweep_by_analyzer(wide: DataFrame, analyzers: Sequence[str] = ANALYZERS, ks: Sequence[int] = SWEEP) -> DataFrame:
    """``analyzer, k, silhouette, n_rows``: 2-D reduction and sweep for each noun column.

    One pass over ``wide`` writes the terms of all analyzers; each reduction reads its own column.
    """
    stored = materialise(wide.select("doc_id", *[noun_terms(F.col(f"{a}_nouns")).alias(f"{a}_terms") for a in analyzers]), "terms")
    parts = []
    for name in analyzers:
        points = _terms_2d(stored.select("doc_id", F.col(f"{name}_terms").alias("terms")))
        means = sweep_means(sweep_scores(points, "doc_id", ks))
        parts.append(means.select(F.lit(name).alias("analyzer"), "k", "silhouette", "n_rows"))
    return reduce(DataFrame.unionByName, parts)


def sweep_scores(
    points: DataFrame, key: str, ks: Sequence[int] = SWEEP, exact: bool = False
) -> DataFrame:
    """``k, key, cluster, a, b, s`` of ``key, point`` for every k.

    The squared form is linear in the rows; ``exact`` measures Euclidean distance over all pairs.
    """
    # Written once: k-means is fitted and scored on the same rows.
    labelled = materialise(kmeans_labels(points, ks), "sweep")
    if exact:
        k_of = F.element_at(F.array(*[F.lit(k) for k in ks]), F.col("labelling") + 1)
        return silhouette_exact(labelled, key, "point").select(
            k_of.alias("k"), key, "cluster", "a", "b", "s"
        )
    parts = [
        silhouette_squared(
            labelled.select(key, "point", F.get("labels", F.lit(i)).alias("cluster")), key, "point", "cluster"
        ).select(F.lit(k).alias("k"), key, "cluster", "a", "b", "s")
        for i, k in enumerate(ks)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def sweep_means(scores: DataFrame) -> DataFrame:
    """Mean silhouette per k."""
    return scores.groupBy("k").agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n_rows"))
