"""Exact order statistics by histogram refinement, without a sort and without a state per value.

A pass counts the values between the bounds of every open rank in ``BUCKETS`` buckets, which partial
aggregation reduces to at most that many rows per task and rank. The bucket that holds the rank gives
its bounds for the next pass, until they are equal. The first pass divides by sign and magnitude, all
later ones evenly between the least and the greatest value of the bucket, so values of any scale need
few passes: each later one settles eleven bits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
# Magnitudes of doubles lie within +-1100 powers of two.
MAGNITUDES = 1100


@dataclass
class _Rank:
    """The value with ``rank`` (from 0) among the values of a column between ``low`` and ``high``."""

    column: str
    rank: int
    low: object = None
    high: object = None
    found: bool = False


def _magnitude(x: Column) -> Column:
    """A bucket that never falls with growing ``x``; NaN is the greatest value, as in Spark's order."""
    size = F.floor(F.log2(F.abs(x))).cast("int") + MAGNITUDES
    return (
        F.when(F.isnan(x), 2 * MAGNITUDES + 2)
        .when(x == 0, 0)
        .when(F.abs(x) == math.inf, F.when(x > 0, 2 * MAGNITUDES + 1).otherwise(-2 * MAGNITUDES - 1))
        .otherwise(F.when(x > 0, size).otherwise(-size))
    )


def _even(x: Column, low, high) -> Column:
    """Buckets of equal width; the greatest value is never in the bucket of the least."""
    width = float(high) - float(low)
    if not math.isfinite(width):  # halves, so that the width is a number
        return F.least(F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * (BUCKETS - 1)), F.lit(BUCKETS - 2)).cast("int")
    share = F.floor((x.cast("double") - float(low)) / width * (BUCKETS - 1)).cast("int") if width else F.lit(0)
    return F.when(x == F.lit(high), BUCKETS - 1).otherwise(F.least(share, F.lit(BUCKETS - 2)))


def _refine(values: DataFrame, ranks: list[_Rank], first: bool) -> None:
    """One pass: closer bounds for every open rank."""
    open_ranks = [(i, r) for i, r in enumerate(ranks) if not r.found]
    wanted = {}  # ranks with equal bounds share their counts
    for i, r in open_ranks:
        wanted.setdefault((r.column, None if first else (r.low, r.high)), []).append(i)
    entries = []
    for k, (column, bounds) in enumerate(wanted):
        x = F.col(column)
        if bounds is None:
            inside, bucket = x.isNotNull(), _magnitude(x.cast("double"))
        else:
            inside, bucket = x.between(*map(F.lit, bounds)), _even(x, *bounds)
        entries.append(F.when(inside, F.struct(F.lit(k).alias("k"), bucket.alias("bucket"), x.alias("x"))))
    cells = values.select(F.explode(F.array(*entries)).alias("cell")).filter("cell IS NOT NULL")
    counted = cells.groupBy("cell.k", "cell.bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("cell.x").alias("low"), F.max("cell.x").alias("high")
    )
    tables: dict[int, list] = {}
    for row in counted.collect():
        tables.setdefault(row["k"], []).append(row)
    for k, members in enumerate(wanted.values()):
        table = sorted(tables.get(k, []), key=lambda r: r["bucket"])
        for i in members:
            r = ranks[i]
            for row in table:
                if r.rank < row["n"]:
                    r.low, r.high = row["low"], row["high"]
                    r.found = r.low == r.high or (r.low != r.low and r.high != r.high)
                    break
                r.rank -= row["n"]


def order_statistics(df: DataFrame, wanted: Sequence[tuple[str, int]]) -> list:
    """The values of ``(column, rank)``, ranks from 0 in ascending order over the non-null values.

    Every pass reads ``df``, so a derived one should be stored first.
    """
    kinds = dict(df.select(*dict.fromkeys(c for c, _ in wanted)).dtypes)
    whole = ("tinyint", "smallint", "int", "bigint")
    ranks = [_Rank(c, rank) for c, rank in wanted]
    for kind in ("bigint", "double"):  # on their own, since integers beyond 2^53 are no doubles
        own = [r for r in ranks if (kinds[r.column] in whole) == (kind == "bigint")]
        values = df.select(*[F.col(c).cast(kind).alias(c) for c in sorted({r.column for r in own})])
        first = True
        while any(not r.found for r in own):
            _refine(values, own, first)
            first = False
    return [r.low for r in ranks]


def exact_quantiles(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """``column, quantile, n, value``: linear interpolation between neighbouring values; NULLs are left out.

    A column without values has NULL quantiles.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict() if columns else {}
    places = [(c, q, q * (counts[c] - 1)) for c in columns for q in quantiles if counts[c]]
    asked = list(dict.fromkeys((c, rank) for c, _, at in places for rank in (math.floor(at), math.ceil(at))))
    value = dict(zip(asked, order_statistics(df, asked)))
    rows = []
    for c, q, at in places:
        low, high = (float(value[c, rank]) for rank in (math.floor(at), math.ceil(at)))
        rows.append((c, float(q), counts[c], low if low == high else low + (high - low) * (at - math.floor(at))))
    rows += [(c, float(q), 0, None) for c in columns for q in quantiles if not counts[c]]
    return df.sparkSession.createDataFrame(rows, "column string, quantile double, n bigint, value double")
