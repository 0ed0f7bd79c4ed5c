"""Result files of a run."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import without_prefix
from tagloom.operators.alignment import align


def pred_label_rows(pairs: DataFrame, label_prefix: str) -> DataFrame:
    """Prediction and true label of every row, both without the prefix."""
    return pairs.select(
        "row_id",
        without_prefix(F.col("pred"), label_prefix).alias("pred"),
        without_prefix(F.col("label"), label_prefix).alias("label"),
    )


def submission_rows(test: DataFrame, predictions: DataFrame, prefix: str, label_prefix: str) -> DataFrame:
    """Input sentence and prediction of every test row, both without their prefix."""
    return align(predictions, test.select("row_id", "input_sentence")).select(
        "row_id",
        without_prefix(F.col("input_sentence"), prefix).alias("input_sentence"),
        without_prefix(F.col("pred"), label_prefix).alias("pred"),
    )


# A compressed file cannot be split, so one task reads at most this many rows.
ROWS_PER_FILE = 20_000


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV with header, no index; quotes are doubled so that the reader gets every value back.

    ``compression`` names a codec that the reader knows by the file's suffix.
    """
    options = {"compression": compression, "maxRecordsPerFile": str(ROWS_PER_FILE)} if compression else {}
    df.write.options(**options).csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; a metrics table has one row per run."""
    metrics.write.json(path)


def write_note(spark: SparkSession, message: str, path: str) -> None:
    spark.createDataFrame([(message,)], "value string").write.text(path)


def run_note(prefix: str, label_prefix: str) -> str:
    """The note kept with a run. Fixed value: its wording."""
    return f"input text: {prefix}: \n, label text: {label_prefix}"


def run_folder(base: str, when: datetime, **settings: object) -> str:
    """Folder named after the settings and the start of a run, safe for any file system."""
    parts = [f"{key}{value}" for key, value in settings.items()]
    name = "_".join([*parts, "date" + when.strftime("%d-%H-%M")])
    return f"{base.rstrip('/')}/run_id={re.sub(r'[^A-Za-z0-9._-]+', '-', name)}"
