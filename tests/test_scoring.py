"""Entity metric and BLEU against plain definitions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.checks import fixtures as fx
from tagloom.operators.alignment import align
from tagloom.operators.scoring import bleu, bleu_stats, entity_f1_macro, with_entity_scores
from tagloom.plans.evaluate import best_runs, evaluate

# id, pred, label, n_pred, n_gold, tp, recalled, f1, acc
GOLDEN = [
    (-1, "a:PS:LC", "a:PS b:LC", 2, 2, 1, 1, 0.5, 0.5),
    (-2, "a:PSb c:LC", "a:PS c:LC", 2, 2, 1, 1, 0.5, 0.5),
    (-3, "a b c d:PS", "a x y z:PS", 1, 1, 0, 0, 0.0, 0.0),
    (-4, "", "a:PS", 0, 1, 0, 0, 0.0, 0.0),
    (-5, "a:PS", "", 1, 0, 0, 0, 0.0, 0.0),
    (-6, "extracted entity: q:PS", "extracted entity: r:PS", 1, 1, 1, 1, 1.0, 1.0),
    (-7, "a:LC a:PS", "a:PS a:LC", 2, 2, 0, 1, 0.0, 0.0),
    (-8, "a:PS a:PS a:PS", "a:PS", 3, 1, 1, 1, 0.5, 1.0),
    (-9, "  a:PS", "b  :PS", 1, 1, 1, 1, 1.0, 1.0),
    (-10, "a:LC a:PS", "a:LC a:PS", 2, 2, 2, 1, 2 / (1 / 1 + 1 / 0.5), 0.5),
    (-11, "no tags at all", "none", 0, 0, 0, 0, 0.0, 0.0),
]


def parse(text):
    """Entities of a label string: tokens in front of a tag and the tag."""
    found, start = [], 0
    for hit in re.finditer(":[A-Za-z]+", text):
        found.append((text[start : hit.start()].split(" "), hit.group()))
        start = hit.end() + 1
    return found


def close(one, other):
    shared = sum(token in other[0] for token in one[0])
    return shared > 0 and shared >= len(one[0]) - 2


def brute_force(pred, label):
    ours, gold = parse(pred), parse(label)
    free, tp = list(range(len(gold))), 0
    for entity in ours:
        hit = next((i for i in free if close(entity, gold[i])), None)
        if hit is not None:
            free.remove(hit)
            tp += gold[hit][1] == entity[1]
    first = [next((e for e in ours if close(g, e)), None) for g in gold]
    recalled = sum(e is not None and e[1] == g[1] for e, g in zip(first, gold))
    if not ours or not gold or not tp or not recalled:
        return len(ours), len(gold), tp, recalled, 0.0, 0.0
    f1 = 2 / (1 / (tp / len(ours)) + 1 / (recalled / len(gold)))
    return len(ours), len(gold), tp, recalled, f1, recalled / len(gold)


def scored(spark, rows):
    frame = spark.createDataFrame(rows, "row_id long, pred string, label string")
    names = ("n_pred", "n_gold", "tp", "recalled", "f1", "acc")
    return {r.row_id: tuple(r[n] for n in names) for r in with_entity_scores(frame).collect()}


def test_golden_rows(spark):
    found = scored(spark, [g[:3] for g in GOLDEN])
    for row_id, pred, label, *want in GOLDEN:
        assert found[row_id] == tuple(want), (row_id, found[row_id])
        assert brute_force(pred, label) == tuple(want)


def test_random_rows_against_brute_force(spark):
    rng = random.Random(7)

    def text():
        pieces = []
        for _ in range(rng.randrange(6)):
            words = " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5)))
            pieces.append(words + rng.choice([":PS", ":LC", ":DT", "", ":PSx", ": "]))
        return rng.choice([" ", "  ", ""]).join(pieces)

    rows = [(i, text(), text()) for i in range(600)]
    found = scored(spark, rows)
    for row_id, pred, label in rows:
        assert found[row_id] == pytest.approx(brute_force(pred, label)), (pred, label)


def test_macro_average(spark, small):
    empty = spark.createDataFrame([], "row_id long, pred string, label string")
    assert tuple(entity_f1_macro(empty).first()) == (None, None)
    assert tuple(evaluate(empty).first()) == (None, None, None)
    row = entity_f1_macro(fx.predictions(spark, "/root/testdata/sf0.01")).first()
    assert (round(row.f1, 6), round(row.acc, 6)) == (0.867568, 0.886636)
    bounds = with_entity_scores(fx.predictions(spark, small)).agg(
        F.min("f1"), F.max("f1"), F.min("acc"), F.max("acc")
    ).first()
    assert tuple(bounds) == (0.0, 1.0, 0.0, 1.0)


def pairs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, pred string, label string")


def test_bleu_published_counts(spark):
    """Known counts of the conversation pairs, with labels cut as in that measurement."""
    cut = fx.table(spark, "/root/testdata/sf0.01", "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), F.substring("text", 1, 400).alias("label")
    )
    pred = (
        F.when(F.col("row_id") % 3 == 0, F.replace("label", F.lit("an"), F.lit("on")))
        .when(F.col("row_id") % 7 == 0, F.lit("a b"))
        .otherwise(F.col("label"))
    )
    row = bleu_stats(cut.withColumn("pred", pred)).first()
    assert tuple(row) == (24428, 23240, 22176, 21197, 25304, 24768, 24232, 23746, 25304, 27666)
    assert bleu(cut.withColumn("pred", pred)).first()[0] == pytest.approx(84.482404, abs=1e-6)


def test_bleu_edges(spark):
    def score(*rows):
        return bleu(pairs(spark, *rows)).first().bleu

    assert score(("a b c d e", "a b c d e")) == pytest.approx(100.0)
    assert score(("x y z w", "a b c d")) == 0.0
    assert score(("a b c", "a b c")) == 0.0
    assert score(("", "a b c d")) == 0.0
    # Orders 3 and 4 have no match: smoothed to 1/2 and 1/4 of one count.
    want = 100 * math.exp(sum(map(math.log, [4 / 5, 1 / 4, 1 / (2 * 3), 1 / (4 * 2)])) / 4)
    assert score(("a b x c d", "a b y d c")) == pytest.approx(want)
    # Brevity penalty.
    assert score(("a b c d", "a b c d e f g h")) == pytest.approx(100 * math.exp(1 - 8 / 4))


def test_bleu_clips_repeated_grams(spark):
    row = bleu_stats(pairs(spark, ("the the the the", "the cat the"))).first()
    assert (row.matches_1, row.matches_2, row.totals_1) == (2, 0, 4)


def test_evaluation_groups_and_best_runs(spark, small):
    frame = fx.predictions(spark, small).withColumn("run_id", F.concat(F.lit("run"), F.col("row_id") % 5))
    metrics = evaluate(frame, by=["run_id"])
    rows = {r.run_id: r for r in metrics.collect()}
    alone = evaluate(frame.filter("run_id = 'run2'")).first()
    assert (rows["run2"].bleu, rows["run2"].f1) == pytest.approx((alone.bleu, alone.f1))
    top = best_runs(metrics).orderBy("place").collect()
    assert [r.run_id for r in top] == sorted(rows, key=lambda k: (-rows[k].f1, k))[:3]


def test_label_prefix_option(spark):
    frame = pairs(spark, ("p: q:PS", "p: r:PS"))
    assert evaluate(frame).first().f1 == 1.0
    assert evaluate(frame, label_prefix="p:").first().f1 == 0.0


def test_counts_do_not_depend_on_partitions(spark, small):
    frame = fx.bleu_pairs(spark, small)
    assert bleu_stats(frame.repartition(1)).first() == bleu_stats(frame.repartition(17)).first()
    assert Counter(bleu_stats(frame).columns) == Counter(set(bleu_stats(frame).columns))


def test_missing_texts_count_as_empty(spark):
    rows = [(1, "a:PS", "a:PS"), (2, None, "b:LC"), (3, "c:TI", None)]
    pairs = spark.createDataFrame(rows, "row_id long, pred string, label string")
    filled = pairs.fillna("")
    assert evaluate(pairs).first() == evaluate(filled).first()


def test_alignment_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "row_id long, pred string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "row_id long, label string")
    with pytest.raises(Exception, match="key occurs twice"):
        align(left, right).collect()
    assert align(left.limit(1), right.limit(1)).columns == ["row_id", "pred", "label"]
