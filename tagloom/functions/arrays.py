"""Array idioms that keep per-row logic inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed.

    A plain reference inside a lambda may be inlined and then re-evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def elements(df: DataFrame, keep: Sequence[str], array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array element, with its position if ``pos`` names one.

    A plain ``explode`` makes the optimizer filter on ``size(array) > 0`` below it, which computes
    a derived array twice and ahead of any repartitioning. The outer form has no such filter; the
    rows of empty arrays are dropped right after.
    """
    if pos is None:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.filter(F.col(pos or name).isNotNull())


def positions(size: Column) -> Column:
    """``[0, 1, ..., size - 1]``; empty for size 0, where ``sequence`` would count down."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>")
    )
