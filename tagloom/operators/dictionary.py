"""Entity dictionaries: the distinct names seen under each tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.arrays import elements
from tagloom.operators.numbering import number_by_hash


def entities(prepared: DataFrame, *keep: str) -> DataFrame:
    """One row per entity: ``pos, raw, name, tag`` and the columns to keep."""
    return elements(prepared, keep, F.col("labels"), "label", pos="pos").select(
        *keep, "pos", "label.raw", "label.name", "label.tag"
    )


def distinct_names(prepared: DataFrame) -> DataFrame:
    return elements(prepared, [], F.col("labels"), "label").select("label.tag", "label.name").distinct()


def entity_dictionary(prepared: DataFrame) -> DataFrame:
    """Long table ``(tag, idx, name)``; ``idx`` runs from 0 within each tag, in hash order."""
    names = distinct_names(prepared)
    numbered = number_by_hash(names, [F.col("name")], [F.col("name")], group=["tag"], name="idx")
    return numbered.select("tag", "idx", "name")


def dictionary_sizes(prepared: DataFrame) -> DataFrame:
    """Distinct names per tag; distinct first, so a frequent tag is spread over its names."""
    return distinct_names(prepared).groupBy("tag").agg(F.count(F.lit(1)).alias("n_names"))
