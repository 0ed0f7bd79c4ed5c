"""Numbering, folds, dictionary and profiles."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.checks import fixtures as fx
from tagloom.operators.alignment import align
from tagloom.operators.dictionary import dictionary_sizes, entity_dictionary
from tagloom.operators.numbering import number_by_hash, number_by_key, number_by_range
from tagloom.operators.profile import label_indicators, length_profile, tag_counts, tag_share, tag_share_mean
from tagloom.operators.split import labelled_split, rows_in, rows_not_in, split_train_valid, stratified_folds
from tagloom.operators.topk import top_n
from tagloom.plans.prepare import prepare


@pytest.fixture(scope="module")
def prepared(spark, small):
    frame = prepare(fx.tagged(spark, small)).persist()
    yield frame
    frame.unpersist()


@pytest.mark.parametrize("k", [4, 10])
def test_folds_are_even_and_stratified(prepared, k):
    rows = stratified_folds(prepared, k).select("row_id", "fold", "joined_entity").collect()
    assert sorted(r.row_id for r in rows) == sorted(r.row_id for r in prepared.select("row_id").collect())
    sizes = Counter(r.fold for r in rows)
    assert set(sizes) == set(range(k)) and max(sizes.values()) - min(sizes.values()) <= 1
    per_signature = Counter((" ".join(sorted(set(r.joined_entity.split()))), r.fold) for r in rows)
    for signature in {s for s, _ in per_signature}:
        counts = [per_signature[(signature, f)] for f in range(k)]
        assert max(counts) - min(counts) <= 1, signature


def test_folds_do_not_depend_on_partitions(prepared):
    one = {tuple(r) for r in stratified_folds(prepared.repartition(1), 10).select("row_id", "fold").collect()}
    many = {tuple(r) for r in stratified_folds(prepared.repartition(17), 10).select("row_id", "fold").collect()}
    assert one == many


def test_seed_changes_folds(prepared):
    a = {tuple(r) for r in stratified_folds(prepared, 10, seed=1).select("row_id", "fold").collect()}
    b = {tuple(r) for r in stratified_folds(prepared, 10, seed=2).select("row_id", "fold").collect()}
    assert a != b


def test_one_signature_may_hold_everything(spark):
    rows = prepare(spark.range(5000).select(F.col("id").alias("row_id"), F.lit("<x:PS>").alias("sentence")))
    sizes = [r["count"] for r in stratified_folds(rows, 7).groupBy("fold").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    untagged = prepare(spark.range(10).select(F.col("id").alias("row_id"), F.lit("none").alias("sentence")))
    assert stratified_folds(untagged, 2).filter("fold = 0").count() == 5


def test_train_and_valid_are_complements(prepared):
    train, valid = split_train_valid(prepared, 4)
    a, b = ({r.row_id for r in part.select("row_id").collect()} for part in (train, valid))
    assert not a & b and len(a) + len(b) == prepared.count()
    ids = valid.select("row_id")
    assert {r.row_id for r in rows_in(prepared, ids).select("row_id").collect()} == b
    assert {r.row_id for r in rows_not_in(prepared, ids).select("row_id").collect()} == a
    split = {r.split: r.n for r in labelled_split(prepared, 4).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert split == {"train": len(a), "valid": len(b)}


def test_numbering_forms(spark):
    rows = spark.range(3000).select((F.col("id") * 37 - 500).alias("key"), (F.col("id") % 3).alias("g"))
    by_key = {r.key: r.position for r in number_by_key(rows, "key", width=1000).collect()}
    assert by_key == {k: i for i, k in enumerate(sorted(by_key))}
    by_hash = number_by_hash(rows, [F.col("key")], [F.col("key")], group=["g"]).collect()
    for g in range(3):
        assert sorted(r.position for r in by_hash if r.g == g) == list(range(1000))


def test_range_numbering_with_hot_group_and_ties(spark):
    rows = spark.range(4000).select(
        "id", F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("g"), F.lit(0.0).alias("s")
    )
    found = number_by_range(rows.repartition(5), [F.col("s"), F.col("id")], group=["g"], size_name="n").collect()
    for g, n in (("hot", 3200), ("cold", 800)):
        mine = sorted((r.id, r.position, r.n) for r in found if r.g == g)
        assert [p for _, p, _ in mine] == list(range(n)) and {m for _, _, m in mine} == {n}


def test_top_n_is_exact(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 7).alias("v"), (F.col("id") % 2).alias("g"))
    found = top_n(rows, 50, [F.col("v").desc(), F.col("id")], ["id"], group=["g"]).collect()
    for g in (0, 1):
        want = sorted(((-(i % 7), i) for i in range(2000) if i % 2 == g))[:50]
        assert sorted(r.id for r in found if r.g == g) == sorted(i for _, i in want)


def test_dictionary(prepared):
    rows = entity_dictionary(prepared).collect()
    sizes = {r.tag: r.n_names for r in dictionary_sizes(prepared).collect()}
    for tag, n in sizes.items():
        mine = [r for r in rows if r.tag == tag]
        assert sorted(r.idx for r in mine) == list(range(n)) and len({r.name for r in mine}) == n


def test_shares(spark):
    counts = spark.createDataFrame([("A", 1), ("B", 7)], "tag string, n_entities long")
    other = spark.createDataFrame([("B", 1), ("C", 1)], "tag string, n_entities long")
    assert {r.tag: r.share_pct for r in tag_share(counts).collect()} == {"A": 12.5, "B": 87.5}
    means = {r.tag: r.mean_pct for r in tag_share_mean(counts, other).collect()}
    assert means == {"A": 6.0, "B": 69.0, "C": 25.0}
    ties = spark.createDataFrame([("A", 1), ("B", 1)], "tag string, n_entities long")
    single = spark.createDataFrame([("A", 3), ("B", 1)], "tag string, n_entities long")
    assert {r.tag: r.mean_pct for r in tag_share_mean(ties, single).collect()} == {"A": 62.0, "B": 38.0}


def test_profiles(spark, prepared):
    counts = {r.tag: r.n_entities for r in tag_counts(prepared).collect()}
    expected = Counter(t for r in prepared.select("entity").collect() for t in r.entity)
    assert counts == dict(expected)
    indicators = label_indicators(prepared).join(prepared.select("row_id", "entity"), "row_id").collect()
    assert all((r.ps == 1) == ("PS" in r.entity) and (r.dt == 1) == ("DT" in r.entity) for r in indicators)
    texts = spark.createDataFrame([("a b",), ("",), ("a",)], "text string")
    row = length_profile(texts, "text", 1).first()
    assert (row.n_rows, row.n_tokens, row.longest, row.above_limit, row.p50) == (3, 3, 2, 1, 1.0)


def test_alignment_is_checked(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, pred string")
    right = spark.createDataFrame([(2, "y"), (1, "x")], "row_id long, label string")
    assert {tuple(r) for r in align(left, right).collect()} == {(1, "a", "x"), (2, "b", "y")}
    with pytest.raises(Exception, match="without partner"):
        align(left, right.filter("row_id = 1")).collect()
    assert align(left, right.filter("row_id = 1"), strict=False).count() == 1


def test_numbers_of_sparse_keys(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    rows = number_by_key(keys, "k").orderBy("k").collect()
    assert [r.position for r in rows] == list(range(20_000))


def test_many_signatures(spark):
    rows = spark.range(30_000).select(F.col("id").alias("row_id"), F.array(F.concat(F.lit("t"), F.col("id") % 10_000)).alias("entity"))
    sizes = [r["count"] for r in stratified_folds(rows, 4).groupBy("fold").count().collect()]
    assert sizes == [7500] * 4
