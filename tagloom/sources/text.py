"""Text lines with stable line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.session import materialise

# A split row takes about 200 bytes.
BROADCAST_SPLITS = 200_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 lines as ``sentence``; ``\\n``, ``\\r\\n`` and ``\\r`` end a line.

    A last line without a line end is kept, and no empty row follows a final line end.
    """
    return spark.read.text(path).withColumnRenamed("value", "sentence")


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, sentence``: 0-based line numbers, files in the order of their paths.

    Spark may pack the splits of many files into partitions in any order, so lines are counted
    per split (file and start offset). Splits follow one another in path and offset order. Inside
    a split the generated row ids are consecutive. The table of splits has a row per split; it is
    broadcast up to ``BROADCAST_SPLITS`` rows, so that lines are not shuffled, and joined beyond.

    Both reads must cut files at the same offsets. Spark derives the split size from the number
    of cores; should that change in between (set ``spark.sql.files.minPartitionNum`` to rule it
    out), the job fails instead of numbering wrongly.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("sentence"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    offsets = materialise(offsets, "splits")
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    row_id = (F.col("_offset") + F.col("_id") - F.col("_first")).cast("bigint")
    moved = F.raise_error(F.lit("files were cut at other offsets in the second read")).cast("bigint")
    return lines.join(offsets, ["_file", "_start"], "left").select(
        F.when(F.col("_offset").isNull(), moved).otherwise(row_id).alias("row_id"), "sentence"
    )


def read_tagged_text(spark: SparkSession, path: str) -> DataFrame:
    return number_lines(spark, path)
