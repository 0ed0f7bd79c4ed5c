"""Label distribution and length profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.arrays import elements
from tagloom.functions.tags import TAGS
from tagloom.functions.text import whitespace_tokens

# Fixed value: tokens of a tag list are runs of at least two word characters.
WORD_REGEX = r"[\p{L}\p{N}_]{2,}+"


def tag_counts(prepared: DataFrame) -> DataFrame:
    """Entities per tag, in tag order."""
    return (
        elements(prepared, [], F.col("entity"), "tag")
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n_entities"))
        .orderBy("tag")
    )


def tag_share(counts: DataFrame) -> DataFrame:
    """Share of each tag in percent, two decimals, ties to even."""
    all_entities = counts.agg(F.sum("n_entities")).scalar()
    share = F.bround(F.col("n_entities") / all_entities * 100, 2)
    return counts.select("tag", share.alias("share_pct"))


def tag_share_mean(train_counts: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Mean of both shares in whole percent, ties to even; a tag missing on one side counts 0."""
    train = tag_share(train_counts).withColumnRenamed("share_pct", "train_pct")
    test = tag_share(test_counts).withColumnRenamed("share_pct", "test_pct")
    both = train.join(test, "tag", "full_outer").fillna(0.0, ["train_pct", "test_pct"])
    mean = F.bround((F.col("train_pct") + F.col("test_pct")) / 2, 0)
    return both.select("tag", "train_pct", "test_pct", mean.alias("mean_pct"))


def label_indicators(prepared: DataFrame, tags: Sequence[str] = TAGS) -> DataFrame:
    """One 0/1 column per tag (lower case): does the row's tag list hold that word?"""
    words = F.array_distinct(
        F.regexp_extract_all(F.lower("joined_entity"), F.lit(WORD_REGEX), F.lit(0))
    )
    return prepared.select("row_id", words.alias("_words")).select(
        "row_id",
        *[F.array_contains("_words", t.lower()).cast("int").alias(t.lower()) for t in tags],
    )


def indicator_tags(prepared: DataFrame) -> DataFrame:
    """The columns of the indicator matrix as they occur in the data, sorted."""
    words = F.array_distinct(
        F.regexp_extract_all(F.lower("joined_entity"), F.lit(WORD_REGEX), F.lit(0))
    )
    return elements(prepared, [], words, "tag").distinct().orderBy("tag")


def split_counts(split: DataFrame) -> DataFrame:
    """Rows and columns of every split in one pass."""
    n_columns = len(split.columns) - 1
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(n_columns).cast("bigint").alias("n_columns")
    )


def length_profile(df: DataFrame, column: str, limit: int, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Token counts of a text column: total, longest, rows above ``limit``, exact quantiles.

    The quantile state holds one entry per distinct length, which the longest text bounds.
    """
    lengths = df.select(F.size(whitespace_tokens(F.col(column))).alias("n"))
    return lengths.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n").cast("bigint").alias("n_tokens"),
        F.max("n").cast("bigint").alias("longest"),
        F.count_if(F.col("n") > limit).alias("above_limit"),
        *[
            F.percentile("n", F.lit(q)).cast("double").alias(f"p{round(q * 100)}")
            for q in quantiles
        ],
    )
