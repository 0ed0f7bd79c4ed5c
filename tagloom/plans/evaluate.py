"""The evaluation job: all metrics of a run in one pass and one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.scoring import (
    bleu_from_sums,
    bleu_sums,
    macro_scores,
    strip_label_prefix,
    with_bleu_counts,
    with_entity_scores,
)
from tagloom.operators.vocab import decode_columns, restore_mask
from tagloom.session import materialise


def evaluate(pairs: DataFrame, by: Sequence[str] = (), label_prefix: str | None = None) -> DataFrame:
    """``bleu, f1, acc`` as one row, or one row per group of ``by``.

    With ``label_prefix`` the prefix is removed from both sides first.
    """
    if label_prefix:
        pairs = strip_label_prefix(pairs, label_prefix)
    scored = with_bleu_counts(with_entity_scores(pairs))
    sums = scored.groupBy(*by).agg(*bleu_sums(), *macro_scores())
    return sums.select(*by, bleu_from_sums().alias("bleu"), "f1", "acc")


def evaluate_ids(
    coded: DataFrame, vocab: DataFrame, by: Sequence[str] = (), label_prefix: str | None = None
) -> DataFrame:
    """The same metrics from ``pred_ids, label_ids`` of a model: unmask, decode, strip, score.

    The texts are written once: scoring reads them several times, and a decoding that is still part
    of the plan cannot be merged into the scoring functions.
    """
    ids = {f"_{c}": restore_mask(F.col(f"{c}_ids")) for c in ("pred", "label")}
    texts = decode_columns(coded.withColumns(ids), vocab, {c: f"_{c}" for c in ("pred", "label")})
    return evaluate(materialise(texts.select(*by, "pred", "label"), "decoded"), by, label_prefix)


def best_runs(metrics: DataFrame, keep: int = 3) -> DataFrame:
    """The ``keep`` best runs by f1 with their ``place``; place 1 is the best. A top-k report."""
    order = [F.col("f1").desc(), F.col("run_id")]
    top = metrics.orderBy(*order).limit(keep)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
