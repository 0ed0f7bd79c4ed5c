"""Sharding by sampled splitters.

Records are ordered by ``(hash of text, doc_id, tie)``, so copies of a text sit side by side. A
size-weighted sample of keys gives quantile boundaries of many small ranges; ranges that turn out
overfull are sampled again and subdivided. Measured totals of the ranges and running totals inside them
then place every record, so shards differ by the size of a record. Only narrow rows (no text) are ever shuffled.

Defined results: a null text has size 1 and the checksum of empty text; a null ``doc_id`` sorts
first; repeated rows are records of their own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.session import materialise

KEY = ("k", "d", "t")
KEY_TYPE = "array<struct<k: bigint, d: bigint, t: bigint>>"
SAMPLES_PER_RANGE = 16
MIN_RANGES, MAX_RANGES, ROWS_PER_RANGE = 1024, 16384, 200_000
MAX_ROUNDS = 4


@dataclass
class Range:
    size: int
    rows: int


def assign_shards(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: shards of near equal bytes.

    The driver holds boundaries and range totals only: at most ``MAX_RANGES`` ranges and the pieces
    of overfull ones, whatever the number of rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("k"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("d"),
        F.monotonically_increasing_id().alias("t"),
    )
    narrow = materialise(narrow, "shard-keys")  # freezes the tie breaker
    total, rows = narrow.agg(F.sum("size"), F.count(F.lit(1))).first()
    bounds = _boundaries(narrow, total or 0, rows)
    ranged = narrow.withColumn("range", _range_of(bounds))
    starts, before = [], 0
    for r in _measure(ranged, len(bounds) + 1):
        starts.append(before)
        before += r.size
    # The shard of a record is where its middle byte falls in the order of all bytes.
    upto = F.sum("size").over(Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0))
    middle = F.get(_longs(starts), F.col("range")) + upto - F.col("size") / 2
    shard = F.least(F.floor(middle * shards / F.lit(float(max(1, before)))), F.lit(shards - 1)).cast("int")
    placed = materialise(ranged.withColumn("shard", shard), "shard-places")
    first_shard, first_slot = _offsets(placed, len(bounds) + 1, shards)
    # Shards follow the order, so only the first shard of a range has records in earlier ranges.
    inside = F.row_number().over(Window.partitionBy("range", "shard").orderBy(*KEY)).cast("long") - 1
    earlier = F.when(F.col("shard") == F.get(_longs(first_shard), F.col("range")), F.get(_longs(first_slot), F.col("range")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (inside + F.coalesce(earlier, F.lit(0))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _boundaries(narrow: DataFrame, total: int, rows: int) -> list[tuple]:
    """Keys that start a new range, in order."""
    ranges = max(MIN_RANGES, min(MAX_RANGES, math.ceil(rows / ROWS_PER_RANGE)))
    mean = max(1.0, total / ranges)
    bounds = _quantiles(_sample(narrow, SAMPLES_PER_RANGE / mean, 0), SAMPLES_PER_RANGE)
    for round_ in range(1, MAX_ROUNDS):
        ranged = narrow.withColumn("range", _range_of(bounds))
        stats = _measure(ranged, len(bounds) + 1)
        overfull = [i for i, s in enumerate(stats) if s.size > 2 * mean and s.rows > 1]
        if not overfull:
            break
        # The bytes of overfull ranges are at most the whole, so this sample is bounded as well.
        picked = ranged.where(F.array_contains(_longs(overfull), F.col("range").cast("long")))
        sample = _sample(picked, SAMPLES_PER_RANGE / mean, round_)
        bounds = sorted({*bounds, *_quantiles(sample, SAMPLES_PER_RANGE)})
    return bounds


def _sample(rows: DataFrame, rate: float, seed: int) -> list[tuple]:
    """``(key, weight)`` drawn with a chance in proportion to size; large rows are certain."""
    chance = F.col("size") * F.lit(rate)
    draw = F.pmod(F.xxhash64(F.lit(seed), "d", "t"), F.lit(2**31)) / F.lit(float(2**31))
    kept = rows.where(draw < chance).select(*KEY, F.greatest(chance, F.lit(1.0)).alias("weight"))
    return sorted(((r.k, r.d, r.t), r.weight) for r in kept.collect())


def _quantiles(sample: list[tuple], weight: float) -> list[tuple]:
    bounds, seen = [], 0.0
    for key, w in sample:
        if seen >= weight:
            bounds.append(key)
            seen = 0.0
        seen += w
    return bounds


def _range_of(bounds: list[tuple]) -> Column:
    """Number of boundaries not above the row's key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    keys = F.from_json(F.lit(json.dumps([dict(zip(KEY, b)) for b in bounds])), KEY_TYPE)
    key = F.struct(*KEY)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])

    def narrow_down(below: Column, step: Column) -> Column:
        here = F.get(keys, below + step - 1)
        return F.when(F.coalesce(here <= key, F.lit(False)), below + step).otherwise(below)

    return F.aggregate(steps, F.lit(0), narrow_down)


def _measure(ranged: DataFrame, n: int) -> list[Range]:
    stats = [Range(0, 0) for _ in range(n)]
    for r in ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect():
        stats[r["range"]] = Range(r["size"], r["rows"])
    return stats


def _offsets(placed: DataFrame, n: int, shards: int) -> tuple[list[int], list[int]]:
    """The first shard of each range, and how many of its records lie in earlier ranges."""
    first_shard, first_slot, used = [-1] * n, [0] * n, [0] * shards
    counts = placed.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("rows")).collect()
    for r in sorted(counts, key=lambda r: (r["range"], r["shard"])):
        if first_shard[r["range"]] < 0:
            first_shard[r["range"]], first_slot[r["range"]] = r["shard"], used[r["shard"]]
        used[r["shard"]] += r["rows"]
    return first_shard, first_slot


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")
