"""Order statistics, frequent items and long rows against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import entity_index as ei
from tagloom.operators import heavy_hitters as hh
from tagloom.operators import order_stats as os_
from tagloom.operators.scoring import with_entity_counts


def spread_values(rng, n):
    """Many magnitudes, ties, both signs, zeros and neighbouring doubles."""
    kinds = [lambda: 0.0, lambda: -0.0, lambda: rng.gauss(0, 1), lambda: rng.choice([1.0, 2.5, -7.0]), lambda: 10.0 ** rng.uniform(-300, 300),
             lambda: -(10.0 ** rng.uniform(-5, 5)), lambda: math.nextafter(1.0, 2.0)]
    return [rng.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("buckets", [4, 2048])
def test_order_statistics_against_sorting(spark, monkeypatch, buckets):
    monkeypatch.setattr(os_, "BUCKETS", buckets)
    rng = random.Random(buckets)
    floats = [*spread_values(rng, 400), None, math.inf, -math.inf, 1.7e308, -1.7e308]
    whole = [rng.choice([rng.randrange(-5, 5), rng.randrange(2**62), -rng.randrange(2**40)]) for _ in floats]
    rows = spark.createDataFrame(list(zip(floats, whole)), "x double, k long").repartition(3)
    ranks = [0, 1, 57, 200, 401, 403]
    values = os_.order_statistics(rows, [("x", r) for r in ranks] + [("k", r) for r in ranks])
    want = [sorted(v for v in floats if v is not None)[r] for r in ranks] + [sorted(whole)[r] for r in ranks]
    assert values == want


def test_quantiles(spark):
    rows = spark.createDataFrame([(1.0, 3), (2.0, 4), (4.0, None), (float("nan"), None)], "x double, k int")
    found = {(r.column, r.quantile): (r.n, r.value) for r in os_.exact_quantiles(rows, ["x", "k"], [0, 0.5, 0.1]).collect()}
    assert found["x", 0.5] == (4, 3.0) and found["k", 0.1] == (2, 3.1) and found["x", 0.0] == (4, 1.0)
    none = os_.exact_quantiles(rows.limit(0), ["x"], [0.5]).collect()
    assert [tuple(r) for r in none] == [("x", 0.5, 0, None)]


@pytest.mark.parametrize("counters", [3, 40, 5000])
def test_heavy_hitters_against_counting(spark, counters):
    """Few counters force candidates and repeats; ties at the limit go to the lesser item."""
    rng = random.Random(counters)
    lists = [[f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(30))] + [None] for _ in range(400)]
    counts = Counter(x for items in lists for x in items if x is not None)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:15]
    rows = spark.createDataFrame([(x,) for x in lists] + [(None,), ([],)], "items array<string>").repartition(5)
    found = hh.heavy_hitters(rows, F.col("items"), 15, counters).collect()
    assert sorted(((r.item, r.n) for r in found), key=lambda x: (-x[1], x[0])) == want
    assert hh.heavy_hitters(rows.limit(0), F.col("items"), 15).count() == 0


def test_heavy_hitters_join_large_candidate_sets(spark, monkeypatch):
    monkeypatch.setattr(hh, "BROADCAST_BYTES", 0)
    test_heavy_hitters_against_counting(spark, 20)


def test_the_tail_is_not_shuffled(spark):
    rows = spark.range(20_000).select(F.array(F.concat(F.lit("rare"), "id"), F.lit("common"), (F.col("id") % 50).cast("string")).alias("items"))
    summary = hh.summaries(rows.repartition(4), 100)
    assert summary.count() <= 4 * 201 + 4
    assert {r.item: r.n for r in hh.heavy_hitters(rows, F.col("items"), 3, 100).collect()} == {"common": 20_000, "0": 400, "1": 400}


def plain_match(pred, gold):
    """The definition, pair by pair."""
    used, hits, found = set(), 0, 0

    def fits(one, other):
        shared = sum(t in other for t in one)
        return shared > 0 and shared >= len(one) - 2

    for tokens, tag in pred:
        at = next((i for i, (other, _) in enumerate(gold) if i not in used and fits(tokens, other)), None)
        if at is not None:
            used.add(at)
            hits += gold[at][1] == tag
    for tokens, tag in gold:
        first = next((t for other, t in pred if fits(tokens, other)), None)
        found += first == tag
    return hits, found


def test_indexed_matching_against_the_definition():
    rng = random.Random(8)
    for _ in range(300):
        words = [f"t{i}" for i in range(rng.choice([2, 5, 40]))] + [""]
        sides = [[([rng.choice(words) for _ in range(rng.randrange(1, 8))], rng.choice([":PS", ":LC"])) for _ in range(rng.randrange(15))] for _ in "ab"]
        assert ei.match_row(*sides) == plain_match(*sides)


def test_long_rows_in_tables(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        n = rng.choice([0, 1, 3, 12])
        texts = [" ".join(f"{' '.join(rng.choice('abcdef') for _ in range(rng.randrange(1, 6)))}:{rng.choice(['PS', 'LC'])}" for _ in range(n)) for _ in "pg"]
        rows.append((i, *texts))
    pairs = spark.createDataFrame([*rows, (99, None, "a:PS")], "row_id long, pred string, label string")
    by_expression = sorted(with_entity_counts(pairs).collect())
    monkeypatch.setattr(ei, "SHORT_ROW_PAIRS", 0)
    assert sorted(with_entity_counts(pairs).collect()) == by_expression


def test_a_row_of_thousands_of_entities():
    import time

    names = [f"n{i % 900} common x{i}" for i in range(5000)]
    gold = [(n.split(), ":PS") for n in names]
    pred = [([*n.split(), "y", "common"], ":PS") for n in reversed(names)]
    began = time.perf_counter()
    hits, found = ei.match_row(pred, gold)
    assert hits == 5000 and found == 5000 and time.perf_counter() - began < 20


def test_sampled_silhouette(spark):
    """Within its bound, and far closer in practice; exact where clusters are small."""
    from tagloom.operators.silhouette import silhouette_exact
    from tagloom.operators.silhouette_sampled import error_bound, silhouette_sampled

    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4, (3, 5))
    rows = [(i, int(c), (centres[c] + rng.standard_t(2, 5)).tolist()) for i, c in enumerate(rng.choice(3, 3000, p=[0.8, 0.19, 0.01]))]
    points = spark.createDataFrame([*rows, (9000, 7, [0.0] * 5), (9001, None, [1.0] * 5), (9002, 1, None)], "vec_id long, label int, embedding array<double>")
    usable = points.dropna().withColumn("labels", F.array("label"))
    exact = {r.vec_id: (r.a, r.b, r.s) for r in silhouette_exact(usable, "vec_id", "embedding").collect()}
    whole = {r.vec_id: (r.a, r.b, r.s) for r in silhouette_sampled(points, "vec_id", "embedding", "label", size=3000).collect()}
    assert whole.keys() == exact.keys()
    assert all(math.isclose(x or 0, y or 0, abs_tol=1e-9) for k in exact for x, y in zip(exact[k], whole[k]))
    some = {r.vec_id: (r.a, r.b, r.s) for r in silhouette_sampled(points.repartition(5), "vec_id", "embedding", "label", size=200).collect()}
    errors = [abs(some[k][i] / exact[k][i] - 1) for k in exact for i in (0, 1) if exact[k][i]]
    assert max(errors) < 0.3 and np.mean(errors) < 0.05
    assert 0.5 < error_bound(1024, 3001, 4) < 1.5 and error_bound(100_000, 3001, 4) < 0.1
    assert abs(np.mean([v[2] for v in some.values()]) - np.mean([v[2] for v in exact.values()])) < 0.02
    assert some[9000][0] is None and some[9000][2] == 0


def test_coreset_sweep(spark):
    """Costs within a tenth of fits to all rows, from a sample of a tenth; weights stand for all rows."""
    from tagloom.operators import coreset as cs

    rng = np.random.default_rng(2)
    centres = rng.normal(0, 6, (5, 4))
    rows = [(i, (centres[i % 5] + rng.normal(0, 1, 4)).tolist()) for i in range(4000)] + [(10_000, [400.0] * 4), (10_001, None)]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sample = cs.coreset(points, "vec_id", "embedding", size=400)
    drawn = sample.collect()
    assert 250 < len(drawn) < 600 and abs(sum(r.weight for r in drawn) / 4001 - 1) < 0.15
    assert any(r.point[0] == 400.0 and r.weight < 1.01 for r in drawn)
    ks = (2, 4, 6)
    costs = [
        {r.k: (r.n_rows, r.cost) for r in cs.sweep_costs(cs.label_all(points, "embedding", cs.fit_centres(s, ks)), ks).collect()}
        for s in (sample, cs.coreset(points, "vec_id", "embedding", size=10_000))
    ]
    assert all(costs[0][k][0] == 4001 and costs[0][k][1] < 1.1 * costs[1][k][1] for k in ks)
    again = cs.coreset(points.repartition(7), "vec_id", "embedding", size=400).count()
    assert again == len(drawn) and cs.coreset(points.limit(0), "vec_id", "embedding").count() == 0


def test_quoted_csv_over_split_borders(spark, tmp_path):
    """Line breaks, quotes and carriage returns in fields, records longer than a split, several files."""
    from tagloom.sources.quoted_csv import read_quoted_csv

    rng = random.Random(3)
    cells = ["plain", 'a "quoted" word', "two\nlines", "\n\n", 'x,"y",\n"z"', "", "wide " * 300 + "\n" + "é" * 200, "cr\r\nlf", None]
    folder = tmp_path / "csv"
    folder.mkdir()
    want = []
    for part in range(3):
        with open(folder / f"{part}.csv", "w", newline="") as file:
            file.write("other,row_id,text\r\n" if part == 1 else "other,row_id,text\n")
            for i in range(200):
                cell = rng.choice(cells)
                key = part * 1000 + i
                want.append((key, cell or None))
                shown = "" if cell is None else '"' + cell.replace('"', '""') + '"' if cell else '""'
                file.write(f'"o\n",{key},{shown}' + ("" if part == 2 and i == 199 else "\r\n" if part == 1 else "\n"))
    limits = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        read = read_quoted_csv(spark, str(folder), "text string, row_id long")
        found = sorted((r.row_id, r.text or None) for r in read.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == sorted(want)
