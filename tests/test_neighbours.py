"""The neighbour graph and the layout against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import neighbours
from tagloom.operators.neighbours import _best, _compare, _compare_parts, _first_links, _members, _packed, _part_sizes, neighbour_graph, neighbour_layout
from tagloom.session import materialise


def brute(vectors, k):
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def trustworthiness(vectors, places, k):
    """Share of the near rows in the layout that are near in space as well, one minus weighted misses."""
    n = len(vectors)
    rank = np.argsort(np.argsort(((vectors[:, None] - vectors[None]) ** 2).sum(2), axis=1), axis=1)
    near = brute(places, k)
    missed = sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i])
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * missed


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (8, 12))
    vectors = centres[rng.integers(0, 8, 900)] + rng.normal(0, 1, (900, 12))
    rows = [(int(i) * 7, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).persist(), vectors


def test_recall_of_the_graph(points):
    frame, vectors = points
    links = neighbour_graph(frame, "vec_id", "embedding", k=10).collect()
    found = {}
    for r in links:
        found.setdefault(r.vec_id // 7, {})[r.neighbour // 7] = r.distance
    assert all(len(v) == 10 and i not in v for i, v in found.items()) and len(found) == 900
    want = brute(vectors, 10)
    assert np.mean([len(set(want[i].tolist()) & set(found[i])) / 10 for i in range(900)]) > 0.9
    assert all(abs(np.linalg.norm(vectors[i] - vectors[j]) - d) < 1e-9 for i, v in found.items() for j, d in v.items())


def test_layout_keeps_neighbourhoods(points):
    frame, vectors = points
    rows = sorted(neighbour_layout(frame, "vec_id", "embedding", k=10).collect())
    places = np.array([r.point for r in rows])
    assert places.shape == (900, 2) and np.isfinite(places).all()
    shadow = vectors @ np.linalg.svd(vectors - vectors.mean(0), full_matrices=False)[2][:2].T
    assert trustworthiness(vectors, places, 10) > max(0.85, trustworthiness(vectors, shadow, 10) + 0.02)


def test_few_equal_and_missing_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "2 AS host")
    links = neighbour_graph(frame, "vec_id", "embedding", k=10)
    assert links.groupBy("vec_id").count().filter("count = 3").count() == 4
    assert all(np.isfinite(r.point).all() for r in neighbour_layout(frame, "vec_id", "embedding", epochs=2).collect())
    assert neighbour_graph(frame.limit(0), "vec_id", "embedding").count() == 0
    assert neighbour_layout(frame.filter("vec_id = 1"), "vec_id", "embedding").count() == 1


def test_only_hosts_with_fresh_links_take_part(spark):
    nodes = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(6)], "node long, _v array<double>")
    ring = [(i, (i + 1) % 6, 1.0, i == 0) for i in range(6)]
    links = spark.createDataFrame(ring, "node long, neighbour long, distance double, fresh boolean")
    assert {r.host for r in _members(links, nodes, 2, 0).collect()} == {0, 1}
    assert _members(links.withColumn("fresh", links.fresh & False), nodes, 2, 0).count() == 0


def test_vectors_are_packed_only_without_loss(spark):
    rows = [(1, [0.5, None]), (2, [float("nan"), 3.0])]
    assert dict(_packed(spark.createDataFrame(rows, "node long, _v array<double>")).dtypes)["_v"] == "array<float>"
    rows.append((3, [0.1, 1.0]))
    assert dict(_packed(spark.createDataFrame(rows, "node long, _v array<double>")).dtypes)["_v"] == "array<double>"


def test_hosts_that_span_batches(spark):
    rng = np.random.default_rng(5)
    hosts, k = 7, 3
    rows = [(h, n, bool(rng.random() < 0.4), 1.5, rng.normal(0, 1, 4).tolist()) for h in range(hosts) for n in range(9)]
    members = spark.createDataFrame(rows, "host long, node long, fresh boolean, worst double, _v array<double>")
    want = []
    for h in range(hosts):
        own = [r for r in rows if r[0] == h]
        for a in own:
            d = sorted((np.sqrt(((np.array(a[4]) - b[4]) ** 2).sum()), b[1]) for b in own if b is not a and (a[2] or b[2]))
            want += [(a[1], n, x) for x, n in d[:k] if x < a[3]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted(tuple(r) for r in _compare(members, k).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)])


@pytest.fixture
def plain_plans(spark):
    """One task for a shuffle, and no broadcasts."""
    conf = {"spark.sql.shuffle.partitions": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in conf}
    for c, value in conf.items():
        spark.conf.set(c, value)
    yield
    for c, value in before.items():
        spark.conf.set(c, value)


def test_pairs_met_at_two_hosts_count_once(spark, plain_plans):
    # The members of the last host are compared on their own.
    rows = [(h, n, True, 9.0, [float(n)]) for h in range(9) for n in range(4)] + [(99, n, True, 9.0, [float(n)]) for n in (50, 51)]
    members = spark.createDataFrame(rows, "host long, node long, fresh boolean, worst double, _v array<double>")
    got = {(r.node, r.neighbour) for r in _compare(members.coalesce(1), 2).collect()}
    assert got == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 1), (50, 51), (51, 50)}


def test_parts_find_what_hosts_find(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n, k = 60, 4
    nodes = spark.createDataFrame([(i, rng.normal(0, 1, 5).tolist()) for i in range(n)], "node long, _v array<double>")
    first = {}
    for size in (7, 60):
        links = _first_links(nodes, n, k, size).collect()
        first[size] = sorted(tuple(r) for r in links)
    assert first[7] == first[60] and [r[:2] for r in first[7]] == sorted((i, (i + s) % n) for i in range(n) for s in range(1, k + 1))
    links = spark.createDataFrame([(*r, True) for r in first[7]], "node long, neighbour long, distance double, fresh boolean")
    rows = nodes.join(links.groupBy("node").agg(F.max("distance").alias("worst")), "node")
    best = {}
    monkeypatch.setattr(neighbours, "MEMBER_ROWS", 20)
    for size in (1, 7, 60):
        members = _members(links, nodes, k, 0, size)
        closer = _compare_parts(members, rows, k) if size > 1 else _compare(members.join(rows, "node"), k)
        closer = closer.withColumn("fresh", F.lit(True))
        best[size] = sorted(tuple(r) for r in _best(links.withColumn("fresh", F.lit(False)).unionByName(closer), k).collect())
    assert best[1] == best[7] == best[60] and any(r[3] for r in best[1])


def test_missing_numbers_and_lengths(spark):
    rows = [(0, [0.0, 1.0]), (1, [None, 1.0]), (2, [3.0, 5.0])]
    nodes = spark.createDataFrame(rows, "node long, _v array<double>")
    got = {(r.node, r.neighbour): r.distance for r in _first_links(nodes, 3, 1, 2).collect()}
    assert got == {(0, 1): None, (1, 2): None, (2, 0): 5.0}


def test_part_sizes():
    assert _part_sizes(900, 10, 96, 8) == (113, 113)
    first, later = _part_sizes(10**8, 15, 256, 8)
    assert later == 1 and first * (256 + 31 * 64) <= neighbours.PART_BYTES


def test_a_vector_is_not_sent_once_per_host(spark, plain_plans):
    n, width = 2000, 64
    rng = np.random.default_rng(11)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (n, width)))], "vec_id long, embedding array<double>")
    frame = materialise(frame, "vectors")

    def written():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    neighbour_graph(frame, "vec_id", "embedding", rounds=1).count()
    assert written() - before < 12 * n * width * 8
