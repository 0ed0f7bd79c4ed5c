"""Folds that keep every label in proportion, by rarest-label-first quotas.

Rows with the same labels are interchangeable, so the folds are settled on the table of label sets and
their counts. Every fold gets the whole part of a set's share; fewer rows than folds are left of each
set. Which folds get those is decided set by set, the sets with the rarest labels first: a fold that has
the fewest left-over rows of the rarest label, then of the next label, then of all rows. Moving single
rows and exchanging rows of two sets then levels what greedy choices of rare labels left uneven in
frequent ones. Each set is within one row of its share by construction; the levelling ends when each
label and the folds as a whole are, too, or when no exchange helps any more.

The table of label sets goes through one task; it has at most one row per combination of labels. Rows
are only numbered inside their label set, as ``row_id`` and the set, and no row moves otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.arrays import elements
from tagloom.operators.numbering import number_by_hash
from tagloom.operators.split import DEFAULT_FOLDS, SEED, signature
from tagloom.session import materialise

SWEEPS = 200  # of levelling, at most
PARTNERS = 256  # sets considered on each side of an exchange


def greedy_choices(members: Sequence[np.ndarray], left: Sequence[int], folds: int, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """``chosen`` (sets x folds) and the left-over rows of each label in each fold; the last line is all rows.

    ``members`` lists the labels of each set by falling rarity; sets come in the order of their rarest labels.
    """
    chosen = np.zeros((len(members), folds), bool)
    held = np.zeros((labels + 1, folds), np.int64)
    for s, (own, n) in enumerate(zip(members, left)):
        lines = np.append(own, labels)
        # lexsort takes its last key first; equal folds are taken from another end for every set.
        turn = (np.arange(folds) - s) % folds
        order = np.lexsort((turn, *held[lines[::-1]]))[:n]
        chosen[s, order] = True
        held[np.ix_(lines, order)] += 1
    return chosen, held


def level_choices(members: Sequence[np.ndarray], chosen: np.ndarray, held: np.ndarray) -> None:
    """Move left-over rows between folds until no label differs by more than one, where that is possible.

    Minimises the sum of squares of ``held``, which is least when every line is level.
    """
    sets, labels = len(members), len(held) - 1
    within = np.zeros((sets, labels + 1), np.int64)
    for s, own in enumerate(members):
        within[s, own] = 1
        within[s, labels] = 1
    size = within.sum(1)
    rng = np.random.default_rng(0)

    def move(s: int, source: int, target: int) -> None:
        chosen[s, source], chosen[s, target] = False, True
        held[:, source] -= within[s]
        held[:, target] += within[s]

    def uneven() -> np.ndarray:
        return np.flatnonzero(held.max(1) - held.min(1) > 1)

    movable = np.flatnonzero(chosen.any(1) & ~chosen.all(1))
    for _ in range(SWEEPS):
        if not len(uneven()):
            return
        for s in rng.permutation(movable):
            weight = within[s] @ held
            source = int(np.where(chosen[s], weight + rng.random(len(weight)) / 2, -1).argmax())
            target = int(np.where(chosen[s], np.inf, weight + rng.random(len(weight)) / 2).argmin())
            if weight[target] - weight[source] + size[s] <= 0:  # equal sums may open another way
                move(s, source, target)
        for line in uneven():
            source, target = int(held[line].argmax()), int(held[line].argmin())
            if held[line, source] - held[line, target] < 2:
                continue
            give = rng.permutation(np.flatnonzero(chosen[:, source] & ~chosen[:, target] & (within[:, line] == 1)))[:PARTNERS]
            take = rng.permutation(np.flatnonzero(chosen[:, target] & ~chosen[:, source] & (within[:, line] == 0)))[:PARTNERS]
            if not len(give) or not len(take):
                continue
            change = within[give][:, None] - within[take][None]
            cost = change @ (held[:, target] - held[:, source]) + (change * change).sum(2)
            i, j = np.unravel_index(cost.argmin(), cost.shape)
            if cost[i, j] <= 0:
                move(give[i], source, target)
                move(take[j], target, source)


def fold_quotas(sets: DataFrame, n_split: int) -> DataFrame:
    """Of ``signature, labels, n``: ``signature, n, base, extra``; the folds in ``extra`` get a row more than ``base``."""
    totals = elements(sets, ["n"], F.col("labels"), "label").groupBy("label").agg(F.sum("n").alias("total"))
    ranked = totals.orderBy("total", "label").toPandas()["label"].tolist()
    rank = {label: i for i, label in enumerate(ranked)}

    def run(batches):
        tables = list(batches)
        if not tables:
            return
        table = pd.concat(tables)
        own = [np.array(sorted(rank[x] for x in labels), np.int64) for labels in table["labels"]]
        order = sorted(range(len(own)), key=lambda i: (*own[i].tolist(), len(rank)))
        members, n = [own[i] for i in order], table["n"].to_numpy()[order]
        chosen, held = greedy_choices(members, (n % n_split).tolist(), n_split, len(rank))
        level_choices(members, chosen, held)
        extra = [np.flatnonzero(row).astype(np.int32) for row in chosen]
        yield pd.DataFrame({"signature": table["signature"].to_numpy()[order], "n": n, "base": n // n_split, "extra": extra})

    one = sets.select("signature", "labels", "n").repartition(1).sortWithinPartitions("signature")
    return one.mapInPandas(run, "signature string, n bigint, base bigint, extra array<int>")


def label_folds(prepared: DataFrame, n_split: int = DEFAULT_FOLDS, seed: int = SEED) -> DataFrame:
    """``row_id, fold`` for rows with an ``entity`` array; independent of the partitioning."""
    rows = materialise(prepared.select("row_id", signature(F.col("entity")).alias("signature")), "label-sets")
    labels = F.when(F.col("signature") == "", F.array().cast("array<string>")).otherwise(F.split("signature", " "))
    sets = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).withColumn("labels", labels)
    quotas = materialise(fold_quotas(materialise(sets, "sets"), n_split), "quotas")
    numbered = number_by_hash(
        rows, [F.col("row_id"), F.lit(seed)], [F.col("row_id")], group=["signature"], name="_rank"
    )
    whole = F.col("base") * n_split
    fold = F.when(F.col("_rank") < whole, F.col("_rank") % n_split).otherwise(F.get("extra", (F.col("_rank") - whole).cast("int")))
    return numbered.join(quotas.drop("n"), "signature").select("row_id", fold.cast("int").alias("fold"))


def split_by_labels(prepared: DataFrame, n_split: int = DEFAULT_FOLDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training rows and, from the first fold, validation rows, with all columns."""
    valid = materialise(label_folds(prepared, n_split, seed).filter("fold = 0").select("row_id"), "valid-ids")
    return prepared.join(valid, "row_id", "left_anti"), prepared.join(valid, "row_id", "left_semi")


def fold_balance(rows: DataFrame, n_split: int) -> DataFrame:
    """How even the folds are: ``kind, name, n_rows, least, most, n_most`` per label, label set and in all.

    ``rows`` have ``entity`` and ``fold``; ``n_most`` counts the folds that hold the greatest number.
    """
    own = F.concat(
        F.transform(F.array_distinct("entity"), lambda x: F.struct(F.lit("label").alias("kind"), x.alias("name"))),
        F.array(
            F.struct(F.lit("set").alias("kind"), signature(F.col("entity")).alias("name")),
            F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")),
        ),
    )
    per_fold = [F.count_if(F.col("fold") == k) for k in range(n_split)]
    counted = elements(rows, ["fold"], own, "own").groupBy("own.kind", "own.name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.array(*per_fold).alias("held")
    )
    most = F.array_max("held")
    return counted.select(
        "kind",
        "name",
        "n_rows",
        F.array_min("held").alias("least"),
        most.alias("most"),
        F.size(F.filter("held", lambda n: n == most)).cast("bigint").alias("n_most"),
    )
