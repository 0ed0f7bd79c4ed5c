"""TF-IDF, clusters and silhouettes against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tagloom.checks import fixtures as fx
from tagloom.operators import cluster
from tagloom.operators import silhouette as silhouette_module
from tagloom.operators import tfidf as tfidf_module
from tagloom.operators.silhouette import silhouette_exact, silhouette_profile, silhouette_squared
from tagloom.operators.tfidf import noun_terms, noun_text, projected, term_documents, terms, tfidf, tfidf_vectors, vocabulary
from tagloom.plans import explore
from tagloom.plans.explore import documents_2d, sweep_means, sweep_scores
from tagloom.session import materialise

DOCS = [
    (0, ["Alpha", "beta", "beta", "x"]),
    (1, ["alpha", "감마", "delta_1"]),
    (2, ["y", "z"]),
    (3, ["beta gamma", "ALPHA"]),
    (4, []),
]


def brute_tfidf(docs, cap):
    sets = {d: set(re.findall(r"\b\w\w+\b", " ".join(nouns).lower())) for d, nouns in docs}
    df = Counter(t for s in sets.values() for t in s)
    kept = sorted(df, key=lambda t: (-df[t], t))[:cap]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for d, s in sets.items():
        norm = math.sqrt(sum(idf[t] ** 2 for t in s if t in idf))
        out.update({(d, t): idf[t] / norm for t in s if t in idf})
    return out


@pytest.mark.parametrize("cap", [3, 25_000])
def test_tfidf(spark, cap):
    docs = spark.createDataFrame(DOCS, "doc_id long, nouns array<string>")
    found = {(r.doc_id, r.term): r.weight for r in tfidf(docs, cap).collect()}
    assert found == pytest.approx(brute_tfidf(DOCS, cap))
    both = docs.withColumn("analyzer", F.lit("a")).unionByName(
        docs.filter("doc_id < 2").withColumn("analyzer", F.lit("b"))
    )
    rows = tfidf(both, cap, by=["analyzer"]).collect()
    assert {(r.doc_id, r.term): r.weight for r in rows if r.analyzer == "b"} == pytest.approx(brute_tfidf(DOCS[:2], cap))


def test_vector_form_has_the_same_weights(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, nouns array<string>")
    terms = term_documents(docs, noun_text(F.col("nouns")), "doc_id")
    vocab = vocabulary(terms, 3)
    order = [r.term for r in vocab.orderBy(F.col("df").desc(), "term").collect()]
    rows = tfidf_vectors(terms, vocab).select("doc_id", vector_to_array("features").alias("v")).collect()
    found = {(r.doc_id, t): x for r in rows for t, x in zip(order, r.v) if x}
    assert found == pytest.approx(brute_tfidf(DOCS, 3))
    assert {r.doc_id: sum(r.v) for r in rows}[4] == 0.0


def test_svd_projection(spark, small):
    docs = fx.noun_table(spark, small).select("doc_id", F.col("okt_nouns").alias("nouns"))
    rows = {r.doc_id: r.point for r in documents_2d(docs, 200).collect()}
    weights = tfidf(docs, 200).collect()
    ids, terms = sorted({r.doc_id for r in weights}), sorted({r.term for r in weights})
    matrix = np.zeros((len(ids), len(terms)))
    for r in weights:
        matrix[ids.index(r.doc_id), terms.index(r.term)] = r.weight
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    found = np.array([rows[d] for d in ids])
    assert np.abs(found) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-5)


def brute_silhouette(x, labels, power=1):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)) ** power
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(301, 3))
    x[:100] = x[0]  # a group of copies holds a third of the rows
    labels = rng.integers(0, 4, 301)
    labels[-1] = 9  # a cluster of one
    other = (labels + np.arange(301)) % 2
    rows = [(i, x[i].tolist(), [int(labels[i]), int(other[i])]) for i in range(301)]
    return x, labels, other, spark.createDataFrame(rows, "vec_id long, x array<double>, labels array<int>")


@pytest.mark.parametrize("block_rows", [40, 1000])
def test_exact_silhouette(points, block_rows):
    x, labels, other, frame = points
    rows = silhouette_exact(frame, "vec_id", "x", block_rows).collect()
    assert len(rows) == 602
    for labelling, want in enumerate((brute_silhouette(x, labels), brute_silhouette(x, other))):
        found = {r.vec_id: r.s for r in rows if r.labelling == labelling}
        assert [found[i] for i in range(301)] == pytest.approx(want, abs=1e-9)


def test_squared_silhouette(points):
    x, labels, _, frame = points
    frame = frame.withColumn("cluster", F.get("labels", F.lit(0)))
    found = {r.vec_id: r.s for r in silhouette_squared(frame, "vec_id", "x", "cluster").collect()}
    assert [found[i] for i in range(301)] == pytest.approx(brute_silhouette(x, labels, 2), abs=1e-6)


def test_squared_mean_equals_the_library_evaluator(spark):
    rows = fx.vectors(spark, "/root/testdata/sf0.01")
    mean = silhouette_squared(rows, "vec_id", "embedding", "label").agg(F.avg("s")).first()[0]
    frame = rows.select(array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("prediction"))
    assert mean == pytest.approx(ClusteringEvaluator().evaluate(frame), abs=1e-9)
    assert mean == pytest.approx(-0.024941, abs=1e-6)
    exact = silhouette_exact(rows.withColumn("labels", F.array("label")), "vec_id", "embedding")
    assert exact.agg(F.avg("s")).first()[0] == pytest.approx(-0.012707, abs=1e-6)


def test_profile_positions(points):
    _, labels, _, frame = points
    scored = silhouette_exact(frame, "vec_id", "x").filter("labelling = 0")
    rows = silhouette_profile(scored, ["cluster"], "vec_id").collect()
    for c in set(labels.tolist()):
        mine = sorted((r for r in rows if r.cluster == c), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(int((labels == c).sum())))
        assert [r.s for r in mine] == sorted(r.s for r in mine)
        assert {r.cluster_size for r in mine} == {len(mine)}


def test_sweep(spark, small):
    vectors = fx.vectors(spark, small)
    points = cluster.pca_2d(vectors)
    scores = sweep_scores(points, "vec_id", ks=(2, 3), exact=True).persist()
    assert {r.k: r.n_rows for r in sweep_means(scores).collect()} == {2: 500, 3: 500}
    assert {r.k: r.n for r in scores.groupBy("k").agg(F.count_distinct("cluster").alias("n")).collect()} == {2: 2, 3: 3}
    squared = sweep_means(sweep_scores(points, "vec_id", ks=(2, 3))).collect()
    assert all(-1 <= r.silhouette <= 1 for r in squared)
    one = {r.vec_id: (r.point, r.cluster) for r in scores.filter("k = 2").join(points, "vec_id").collect()}
    x, labels = np.array([one[i][0] for i in range(500)]), np.array([one[i][1] for i in range(500)])
    want = brute_silhouette(x, labels).mean()
    assert {r.k: r.silhouette for r in sweep_means(scores).collect()}[2] == pytest.approx(want, abs=1e-9)


def test_centres(spark, small):
    vectors = fx.vectors(spark, small)
    centres = cluster.cluster_means(vectors, "label", "embedding")
    rows = cluster.assign_to_centres(vectors, centres, "embedding").collect()
    means = {r.label: np.array(r.centre) for r in centres.collect()}
    for r in rows[:100]:
        d = {c: ((np.array(r.embedding) - m) ** 2).sum() for c, m in means.items()}
        assert r.cluster == min(d, key=d.get)


def test_more_than_a_thousand_clusters(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    labels = np.arange(3000) % 1200
    frame = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(3000)], "vec_id long, x array<double>, c int")
    found = {r.vec_id: r.s for r in silhouette_squared(frame, "vec_id", "x", "c").collect()}
    assert [found[i] for i in range(3000)] == pytest.approx(brute_silhouette(x, labels, 2), abs=1e-6)
    centres = cluster.cluster_means(frame, "c", "x")
    table = {r.c: np.array(r.centre) for r in centres.collect()}
    means = np.array([table[c] for c in range(1200)])
    near = {r.vec_id: r.cluster for r in cluster.assign_to_centres(frame, centres, "x").collect()}
    want = ((x[:, None, :] - means[None]) ** 2).sum(-1).argmin(1)
    assert [near[i] for i in range(3000)] == want.tolist()
    moved = {r.cluster: r.centre for r in cluster.centre_update(frame, centres, "x").collect()}
    assert moved[int(want[0])] == pytest.approx(x[want == want[0]].mean(0).tolist())


def test_reduction_keeps_every_document(spark):
    rows = spark.createDataFrame([(1, ["ab"]), (2, ["ab"]), (3, ["z"]), (4, [])], "doc_id long, nouns array<string>")
    points = {r.doc_id: r.point for r in documents_2d(rows).collect()}
    assert [abs(v) for v in points[1]] == pytest.approx([1.0, 0.0]) and points[3] == points[4] == [0.0, 0.0]
    rows = rows.unionByName(spark.createDataFrame([(5, ["ab", "cd"])], rows.schema))
    assert {r.doc_id for r in documents_2d(rows).collect()} == {1, 2, 3, 4, 5}


def test_pca_against_numpy(spark, small):
    frame = fx.vectors(spark, small)
    rows = sorted(cluster.pca_2d(frame).collect())
    x = np.array([r.embedding for r in frame.orderBy("vec_id").collect()])
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.abs([r.point for r in rows]) == pytest.approx(np.abs(x @ axes.T), abs=1e-6)


def test_fitted_clusters_are_a_fixed_point(spark, small):
    points = cluster.pca_2d(fx.vectors(spark, small))
    labelled = cluster.kmeans_labels(points, ks=(3,)).withColumn("c", F.get("labels", F.lit(0))).persist()
    centres = cluster.cluster_means(labelled, "c", "point")
    again = cluster.assign_to_centres(labelled, centres, "point")
    assert again.filter("c <> cluster").count() <= 2  # the fit stops at a tolerance


def test_weights_agree_on_both_paths(spark, small, monkeypatch):
    docs = fx.noun_table(spark, small).select("doc_id", F.col("okt_nouns").alias("nouns"))
    near = {(r.doc_id, r.term): r.weight for r in tfidf(docs, 300).collect()}
    monkeypatch.setattr(tfidf_module, "BROADCAST_BYTES", 0)
    far = {(r.doc_id, r.term): r.weight for r in tfidf(docs, 300).collect()}
    assert near.keys() == far.keys() and all(near[k] == pytest.approx(far[k]) for k in near)


def test_exact_silhouette_keeps_small_distances(spark):
    """Far from the origin, with copies and near copies: the matrix product alone would lose them."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 6)), 3, axis=0) + 1e4
    x[::3] += rng.normal(size=(40, 6)) * 1e-7
    labels = rng.integers(0, 3, len(x))
    rows = [(i, v.tolist(), [int(c)]) for i, (v, c) in enumerate(zip(x, labels))]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>, labels array<int>")
    own = {r.vec_id: r.s for r in silhouette_exact(points, "vec_id", "embedding", 25).collect()}
    assert [own[i] for i in range(len(x))] == pytest.approx(brute_silhouette(x, labels), abs=1e-9)


def test_distances_of_a_tile_take_no_pass_per_dimension():
    """Small distances are exact; the time does not grow with passes over the tile per dimension."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 512))
    b = np.concatenate([a[:20], a[20:40] + 1e-9, rng.normal(size=(20, 512))])
    found = silhouette_module._distances(a, b)
    assert found == pytest.approx(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)), rel=1e-9, abs=1e-15)
    assert (np.diag(found)[:20] == 0).all()


def test_repeated_nouns_are_dropped_before_terms_are_matched(spark):
    rows = [(1, ["ab-cd", "AB", None, "ab-cd", "x", "ef"]), (2, []), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, nouns array<string>")
    found = docs.select("doc_id", noun_terms(F.col("nouns")).alias("v"), terms(noun_text(F.col("nouns"))).alias("w")).collect()
    assert {r.doc_id: r.v for r in found} == {1: ["ab", "cd", "ef"], 2: [], 3: None} and all(r.v == r.w for r in found)


def test_sweep_writes_the_terms_of_all_analyzers_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(explore, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    rows = [(i, [f"w{i % 3}", f"v{i % 4}", "all"], [f"u{i % 2}", "all"]) for i in range(12)]
    wide = spark.createDataFrame(rows, "doc_id long, a_nouns array<string>, b_nouns array<string>")
    got = explore.sweep_by_analyzer(wide, ("a", "b"), (2,)).collect()
    assert sorted((r.analyzer, r.k, r.n_rows) for r in got) == [("a", 2, 12), ("b", 2, 12)]
    assert written.count("terms") == 1


def test_projection_of_documents_on_axes(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, ["zz"]), (3, []), (4, None)], "doc_id long, terms array<string>")
    entries, axes = [{"term": "a", "idf": 3.0}, {"term": "b", "idf": 4.0}], [(1.0, 0.5), (0.0, 2.0)]
    got = {r.doc_id: r.point for r in projected(docs, entries, axes).collect()}
    assert got == {1: pytest.approx([0.6, 1.9]), 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}
