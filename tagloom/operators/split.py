"""Multilabel stratified folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.numbering import number_by_hash
from tagloom.session import materialise

# The default seed and number of folds.
SEED = 1514
DEFAULT_FOLDS = 4

MODEL_COLUMNS = ("input_sentence", "train_label")


def signature(tags: Column) -> Column:
    """The sorted set of a row's tags as one string, never NULL."""
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(tags)), " "), F.lit(""))


def stratified_folds(prepared: DataFrame, n_split: int = DEFAULT_FOLDS, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` in ``[0, n_split)``.

    Rows are dealt out in turn in the order (signature, hash of row and seed). Fold sizes differ
    by at most one row, and so do the folds' shares of every signature. The rows of one
    signature are numbered in hash buckets, so a signature may hold any part of the corpus.
    """
    numbered = number_by_hash(
        prepared.withColumn("_signature", signature(F.col("entity"))),
        [F.col("row_id"), F.lit(seed)],
        [F.col("row_id")],
        group=["_signature"],
        restart=False,
        name="_rank",
    )
    fold = F.pmod(F.col("_rank"), F.lit(n_split)).cast("int")
    return numbered.withColumn("fold", fold).drop("_signature", "_rank")


def _valid_ids(prepared: DataFrame, n_split: int, seed: int) -> DataFrame:
    """``row_id`` of the first fold. Only ids and label sets are numbered; texts stay where they are."""
    folds = stratified_folds(prepared.select("row_id", "entity"), n_split, seed)
    return materialise(folds.filter("fold = 0").select("row_id"), "valid-ids")


def split_train_valid(
    prepared: DataFrame, n_split: int = DEFAULT_FOLDS, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """The first fold is the validation set, all others the training set. ``row_id`` is a key."""
    valid = _valid_ids(prepared, n_split, seed)
    return rows_not_in(prepared, valid).select(*prepared.columns), rows_in(prepared, valid).select(*prepared.columns)


def model_columns(prepared: DataFrame, *keep: str) -> DataFrame:
    return prepared.select(*keep, *MODEL_COLUMNS)


def labelled_split(prepared: DataFrame, n_split: int = DEFAULT_FOLDS, seed: int = SEED) -> DataFrame:
    """The model-ready pair as one table with a ``split`` column, ready to be written by it."""
    valid = _valid_ids(prepared, n_split, seed).withColumn("_valid", F.lit(True))
    split = F.when(F.col("_valid"), "valid").otherwise("train")
    rows = model_columns(prepared, "row_id").join(valid, "row_id", "left")
    return rows.select("row_id", split.alias("split"), *MODEL_COLUMNS)


def rows_in(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``row_id`` is in ``ids``."""
    return df.join(ids.select("row_id"), "row_id", "left_semi")


def rows_not_in(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("row_id"), "row_id", "left_anti")
