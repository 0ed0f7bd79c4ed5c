"""Entity F1 / accuracy and corpus BLEU over ``row_id, pred, label``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.entity_index import is_long, match_counts
from tagloom.functions.ngrams import BLEU_COLUMNS, MAX_ORDER, ORDERS, bleu_counts
from tagloom.functions.segments import accuracy, f1_score, recalled, segments, true_positives
from tagloom.functions.text import without_prefix


def strip_label_prefix(pairs: DataFrame, label_prefix: str) -> DataFrame:
    return pairs.withColumns({c: without_prefix(F.col(c), label_prefix) for c in ("pred", "label")})


def with_entity_counts(pairs: DataFrame) -> DataFrame:
    """Adds ``n_pred, n_gold, tp, recalled``. Row-local, nothing is shuffled.

    Rows with many entities are matched through an index, all others by expressions.
    """
    pred, gold = F.col("_pred"), F.col("_gold")
    parsed = pairs.withColumns({"_pred": segments(F.col("pred")), "_gold": segments(F.col("label"))})
    indexed = parsed.withColumn("_indexed", match_counts(pred, gold))
    long = is_long(pred, gold)
    return indexed.withColumns(
        {
            "n_pred": F.size(pred).cast("bigint"),
            "n_gold": F.size(gold).cast("bigint"),
            "tp": F.when(long, F.col("_indexed.tp")).otherwise(true_positives(pred, gold).cast("bigint")),
            "recalled": F.when(long, F.col("_indexed.recalled")).otherwise(recalled(pred, gold).cast("bigint")),
        }
    ).drop("_pred", "_gold", "_indexed")


def with_entity_scores(pairs: DataFrame) -> DataFrame:
    """Adds the counts and ``f1, acc`` of every row."""
    return with_entity_counts(pairs).withColumns(
        {
            "f1": f1_score(F.col("tp"), F.col("n_pred"), F.col("recalled"), F.col("n_gold")),
            "acc": accuracy(F.col("tp"), F.col("recalled"), F.col("n_gold")),
        }
    )


def macro_scores() -> list[Column]:
    return [F.avg("f1").alias("f1"), F.avg("acc").alias("acc")]


def with_bleu_counts(pairs: DataFrame) -> DataFrame:
    """Adds clipped matches and totals per order and both lengths. Row-local as well.

    A missing prediction or label counts as empty text, as in the entity scores.
    """
    sides = [F.coalesce(F.col(c), F.lit("")) for c in ("pred", "label")]
    counted = pairs.withColumn("_bleu", bleu_counts(*sides))
    return counted.select(*pairs.columns, "_bleu.*")


def bleu_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in BLEU_COLUMNS]


def bleu_from_sums() -> Column:
    """Geometric mean of the precisions times the brevity penalty, in percent.

    An order without matches is smoothed: its precision is 1 / (2**z * total), z counting such
    orders so far. No match at all, or no n-gram of some order, scores 0.
    """
    misses, logs = F.lit(0), F.lit(0.0)
    for n in ORDERS:
        matches, totals = F.col(f"matches_{n}"), F.nullif(F.col(f"totals_{n}"), F.lit(0))
        misses = misses + F.when(matches == 0, 1).otherwise(0)
        hit = F.when(matches > 0, matches).otherwise(F.lit(1.0) / F.pow(F.lit(2.0), misses))
        logs = logs + F.ln(F.lit(100.0) * hit / totals)
    pred_len, label_len = F.col("pred_len"), F.col("label_len")
    brevity = F.when(
        pred_len < label_len, F.exp(F.lit(1.0) - label_len / F.nullif(pred_len, F.lit(0)))
    ).otherwise(F.lit(1.0))
    any_match = F.greatest(*[F.col(f"matches_{n}") for n in ORDERS]) > 0
    score = F.when(any_match, brevity * F.exp(logs / MAX_ORDER)).otherwise(F.lit(0.0))
    return F.when(pred_len.isNotNull(), F.coalesce(score, F.lit(0.0)))


def entity_f1_macro(pairs: DataFrame) -> DataFrame:
    """Mean f1 and acc over all rows; NULL for no rows."""
    return with_entity_scores(pairs).agg(*macro_scores())


def bleu_stats(pairs: DataFrame) -> DataFrame:
    return with_bleu_counts(pairs).agg(*bleu_sums())


def bleu(pairs: DataFrame) -> DataFrame:
    return bleu_stats(pairs).select(bleu_from_sums().alias("bleu"))
