"""Literal corrections of single known rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the one unclosed tag known in the training file (0-based line number).
KNOWN_CORRECTIONS = ((10212, "일녀<QT>", "<일녀:QT>"),)

CORRECTION_SCHEMA = "row_id long, find string, replacement string"


def known_corrections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN_CORRECTIONS), CORRECTION_SCHEMA)


def apply_corrections(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace ``find`` by ``replacement`` in ``sentence`` of the named rows.

    Several corrections of one row apply in the order of ``find``; a row that is not there is
    ignored. The table is joined by key, so a small one is broadcast by its measured size.
    """
    per_row = corrections.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("find", "replacement"))).alias("_fixes")
    )
    fixed = F.aggregate(
        F.col("_fixes"),
        F.col("sentence"),
        lambda text, fix: F.replace(text, fix["find"], fix["replacement"]),
    )
    return (
        df.join(per_row, "row_id", "left")
        .withColumn("sentence", F.coalesce(fixed, F.col("sentence")))
        .drop("_fixes")
        .select(*df.columns)
    )
