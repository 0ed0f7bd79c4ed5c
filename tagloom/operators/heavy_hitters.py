"""The most frequent items, exactly, without a shuffle of the long tail.

Every task keeps a summary of bounded size (Misra and Gries): when it holds too many items, the same
amount is taken from all counts and what falls to zero is forgotten. A summary so never counts too
much, and too little by no more than it took in all. Merged counts are lower bounds, and no item can
exceed its lower bound by more than the sum of what all tasks took. If that sum is below the n-th best
lower bound, every item that may be among the n best is known; those candidates are counted exactly in a
second pass. Otherwise the first pass is repeated with more counters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.arrays import elements
from tagloom.operators.topk import top_n
from tagloom.session import materialise

COUNTERS = 8  # kept by a task, per item wanted
GROWTH = 8  # of the counters, when they did not suffice
BROADCAST_BYTES = 32 << 20
ITEM_OVERHEAD = 100
COUNTED = "item string, n bigint"


def _counted(items: pa.Array) -> Counter:
    """Counts of the non-null items of a batch of lists."""
    found = pc.value_counts(items.flatten().drop_null())
    return Counter(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))


def _table(counts: dict) -> pa.RecordBatch:
    columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["item", "n"])


def summaries(lists: DataFrame, counters: int) -> DataFrame:
    """``item, n`` of every task's summary; its row with a null item holds what it took from each count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        taken = 0
        for batch in batches:
            held.update(_counted(batch["items"]))
            if len(held) > 2 * counters:
                values = np.fromiter(held.values(), np.int64, len(held))
                cut = int(np.partition(values, len(values) - counters - 1)[len(values) - counters - 1])
                held = Counter({item: n - cut for item, n in held.items() if n > cut})
                taken += cut
        yield _table(held)
        yield _table({None: taken})

    return lists.mapInArrow(run, COUNTED)


def _exact(lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """``item, n`` of the candidates only; looked up inside the row where their size allows it."""
    size = candidates.agg(F.sum(F.octet_length("item") + ITEM_OVERHEAD)).first()[0] or 0
    if size > BROADCAST_BYTES:
        spread = elements(lists, [], F.col("items"), "item").join(candidates.select("item"), "item", "left_semi")
        return spread.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    shared = lists.sparkSession.sparkContext.broadcast({r["item"] for r in candidates.select("item").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update({item: n for item, n in _counted(batch["items"]).items() if item in shared.value})
        yield _table(held)

    return lists.mapInArrow(run, COUNTED).groupBy("item").agg(F.sum("n").alias("n"))


def heavy_hitters(df: DataFrame, items: Column, n: int, counters: int | None = None) -> DataFrame:
    """``item, n`` of the ``n`` most frequent elements of an array column; of equal counts the lesser item.

    Null items are not counted. ``df`` is read at least twice.
    """
    lists = df.select(items.cast("array<string>").alias("items")).filter(F.size("items") > 0)
    counters = counters or COUNTERS * max(n, 1)
    while True:
        merged = summaries(lists, counters).groupBy("item").agg(F.sum("n").alias("n"))
        merged = materialise(merged, "summaries")
        slack = merged.filter("item IS NULL").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        known = merged.filter("item IS NOT NULL")
        least = top_n(known, n, [F.col("n").desc(), F.col("item")], ["item"]).agg(
            F.count(F.lit(1)).alias("found"), F.min("n").alias("least")
        ).first()
        if not slack or (least["found"] == n and slack < least["least"]):
            break
        counters *= GROWTH
    if not slack:
        counted = known  # nothing was ever taken: the counts are exact
    else:
        candidates = materialise(known.filter(F.col("n") + slack >= least["least"]), "candidates")
        counted = _exact(lists, candidates)
    return top_n(counted, n, [F.col("n").desc(), F.col("item")], ["item"])
