"""From tagged sentences to model-ready rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.cleaning import clean_sentence
from tagloom.functions.tags import joined_tags, label_string, tag_structs
from tagloom.functions.text import with_prefix
from tagloom.operators.corrections import apply_corrections, known_corrections
from tagloom.sources.text import read_tagged_text

# The prompt prefixes of the published run.
PREFIX = "extract entity:"
LABEL_PREFIX = "extracted entity:"


def prepare(
    tagged: DataFrame,
    prefix: str = "",
    label_prefix: str = "",
    corrections: DataFrame | None = None,
) -> DataFrame:
    """Adds ``labels, train_label, name, entity, input_sentence, joined_entity``.

    All steps are row-local; with ``corrections`` there is one join with that small table.
    Works on batch and streaming frames alike.
    """
    if corrections is not None:
        tagged = apply_corrections(tagged, corrections)
    labels = F.col("labels")
    return tagged.withColumn("labels", tag_structs(F.col("sentence"))).select(
        *tagged.columns,
        "labels",
        with_prefix(label_string(labels), label_prefix).alias("train_label"),
        labels["name"].alias("name"),
        labels["tag"].alias("entity"),
        with_prefix(clean_sentence(F.col("sentence")), prefix).alias("input_sentence"),
        joined_tags(labels).alias("joined_entity"),
    )


def read_train(spark, path: str, prefix: str = "", label_prefix: str = "") -> DataFrame:
    """Training file: the known bad row is corrected first."""
    return prepare(read_tagged_text(spark, path), prefix, label_prefix, known_corrections(spark))


def read_test(spark, path: str, prefix: str = "", label_prefix: str = "") -> DataFrame:
    return prepare(read_tagged_text(spark, path), prefix, label_prefix)


def prepare_basic(tagged: DataFrame) -> DataFrame:
    """Profiling variant: the label list is kept and repeated marks are not collapsed."""
    labels = F.col("labels")
    return tagged.withColumn("labels", tag_structs(F.col("sentence"))).select(
        *tagged.columns,
        "labels",
        labels["raw"].alias("train_label"),
        labels["name"].alias("name"),
        labels["tag"].alias("entity"),
        clean_sentence(F.col("sentence"), collapse_marks=False).alias("org_sentence"),
    )
