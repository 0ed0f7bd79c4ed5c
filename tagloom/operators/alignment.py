"""One-to-one alignment of predictions with gold labels or inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(predictions: DataFrame, others: DataFrame, key: str = "row_id", strict: bool = True) -> DataFrame:
    """Inner join on the key. ``strict`` fails the job when a row has no partner or a key occurs twice.

    The checks are part of the join: keys are counted in the partitioning that the join uses.
    """
    if not strict:
        return predictions.join(others, key)

    def counted(side: DataFrame, name: str) -> DataFrame:
        rest = F.struct(*[c for c in side.columns if c != key])
        return side.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n_{name}"), F.first(rest).alias(f"_{name}"))

    joined = counted(predictions, "left").join(counted(others, "right"), key, "full_outer")
    n_left, n_right = F.col("_n_left"), F.col("_n_right")
    fault = (
        F.when(n_left.isNull() | n_right.isNull(), F.raise_error(F.lit("row without partner in alignment")))
        .when((n_left > 1) | (n_right > 1), F.raise_error(F.lit("key occurs twice in alignment")))
        .otherwise(F.lit(False))
    )
    return joined.filter(~fault).select(key, "_left.*", "_right.*")
