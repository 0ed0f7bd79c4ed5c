"""Quotas per label against the iterative definition, and the folds of rows."""

import random
from collections import Counter

import numpy as np
import pytest

from tagloom.operators import label_folds as lf


def iterative(rows, k, rng):
    """Iterative stratification as published: rarest label first, row by row."""
    names = sorted({x for r in rows for x in r})
    at = {x: i for i, x in enumerate(names)}
    want = np.array([[sum(x in r for r in rows) / k for x in names] for _ in range(k)]).reshape(k, -1)
    room, folds, left = np.full(k, len(rows) / k), {}, set(range(len(rows)))
    while left:
        counts = Counter(x for i in left for x in rows[i])
        rarest = min(counts, key=lambda x: (counts[x], x)) if counts else None
        for i in [i for i in sorted(left) if rarest is None or rarest in rows[i]]:
            need = want[:, at[rarest]] if counts else room
            best = np.flatnonzero(need == need.max())
            best = best[room[best] == room[best].max()]
            fold = int(rng.choice(best.tolist()))
            folds[i] = fold
            room[fold] -= 1
            want[fold, [at[x] for x in rows[i]]] -= 1
            left.discard(i)
    return [folds[i] for i in range(len(rows))]


def unevenness(rows, folds, k):
    """The greatest difference between two folds, over all labels and all rows."""
    lines = [*{x for r in rows for x in r}, None]
    held = [np.bincount([f for r, f in zip(rows, folds) if x is None or x in r], minlength=k) for x in lines]
    return max(int(h.max() - h.min()) for h in held)


def ours(rows, k):
    sets = Counter(tuple(sorted(r)) for r in rows)
    totals = Counter(x for r in rows for x in r)
    rank = {x: i for i, x in enumerate(sorted(totals, key=lambda x: (totals[x], x)))}
    own = {s: np.array(sorted(rank[x] for x in s), np.int64) for s in sets}
    order = sorted(sets, key=lambda s: (*own[s].tolist(), len(rank)))
    left = [sets[s] % k for s in order]
    chosen, held = lf.greedy_choices([own[s] for s in order], left, k, len(rank))
    lf.level_choices([own[s] for s in order], chosen, held)
    assert chosen.sum(1).tolist() == left
    return int((held.max(1) - held.min(1)).max())


@pytest.mark.parametrize("labels, n, k", [(6, 3000, 10), (6, 500, 4), (20, 2000, 5), (20, 300, 10), (12, 100, 7), (3, 5, 10)])
def test_every_label_is_within_one_row_of_its_share(labels, n, k):
    rng = random.Random(labels * k)
    share = [rng.random() ** 2 * 0.6 for _ in range(labels)]
    rows = [frozenset(f"t{i}" for i in range(labels) if rng.random() < share[i]) for _ in range(n)]
    level = ours(rows, k)
    assert level <= 1 and level <= unevenness(rows, iterative(rows, k, rng), k)


def frame(spark, rows):
    return spark.createDataFrame([(i, list(tags)) for i, tags in enumerate(rows)], "row_id long, entity array<string>")


def test_folds_of_rows(spark):
    """Rare labels, rows without labels, repeated tags; the same folds for any partitioning."""
    rng = random.Random(4)
    rows = [[t for t, p in (("PS", 0.9), ("LC", 0.4), ("QT", 0.02), ("TI", 0.004)) if rng.random() < p] for _ in range(2000)]
    rows += [["PS", "PS"], [], ["TI", "QT"]]
    first = {r.row_id: r.fold for r in lf.label_folds(frame(spark, rows).repartition(7), 8).collect()}
    again = {r.row_id: r.fold for r in lf.label_folds(frame(spark, rows).repartition(2), 8).collect()}
    assert first == again and sorted(first) == list(range(len(rows)))
    folds = [first[i] for i in range(len(rows))]
    assert unevenness([set(r) for r in rows], folds, 8) <= 1
    for tags in {tuple(sorted(set(r))) for r in rows}:
        held = np.bincount([f for r, f in zip(rows, folds) if tuple(sorted(set(r))) == tags], minlength=8)
        assert held.max() - held.min() <= 1
    other = {r.row_id: r.fold for r in lf.label_folds(frame(spark, rows), 8, seed=3).collect()}
    assert other != first


def test_split_keeps_all_columns(spark):
    rows = frame(spark, [["PS"]] * 30 + [["LC"]] * 10).selectExpr("*", "'x' AS signature", "1 AS fold")
    train, valid = lf.split_by_labels(rows, 10)
    assert train.columns == valid.columns == rows.columns
    assert (train.count(), valid.count()) == (36, 4) and valid.filter("entity[0] = 'LC'").count() == 1


def test_no_rows(spark):
    assert lf.label_folds(frame(spark, [[]]).limit(0), 4).count() == 0
    assert lf.fold_balance(frame(spark, [["A"], []]).selectExpr("*", "row_id AS fold"), 3).count() == 4
