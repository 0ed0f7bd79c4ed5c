"""Exact top-n reports in two steps, so that no task ranks all candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_n(
    df: DataFrame, n: int, order: Sequence[Column], spread: Sequence[str], *, group: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` rows per group in ``order``, which must break all ties.

    The first step keeps ``n`` rows per (group, salt), the second ``n`` per group out of at most
    ``SALTS * n``. The result does not depend on the salts.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    for keys in ([*group, "_salt"], list(group)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return salted.drop("_salt", "_rank")
