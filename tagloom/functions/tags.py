"""Inline tag extraction: ``<name:TAG>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag set of the corpus (date, location, organisation, person, quantity, time).
TAGS = ("DT", "LC", "OG", "PS", "QT", "TI")

# From the first '<' over the next ':' to the next '>', within one line. Negated classes and a
# possessive quantifier instead of lazy dots: the same matches without the backtracking.
TAG_REGEX = r"<[^:\n]*+:[^>\n]*+>"


def raw_tags(sentence: Column) -> Column:
    """``array<string>`` of all tags in order, without their angle brackets."""
    found = F.regexp_extract_all(sentence, F.lit(TAG_REGEX), F.lit(0))
    return F.transform(found, lambda tag: F.translate(tag, "<>", ""))


def split_tag(raw: Column) -> Column:
    """``name`` is the part before the first colon, ``tag`` the part after the last."""
    return F.struct(
        raw.alias("raw"),
        F.substring_index(raw, ":", 1).alias("name"),
        F.substring_index(raw, ":", -1).alias("tag"),
    )


def tag_structs(sentence: Column) -> Column:
    """``array<struct<raw,name,tag>>``; empty for a sentence without tags."""
    return F.transform(raw_tags(sentence), split_tag)


def label_string(labels: Column) -> Column:
    return F.array_join(labels["raw"], " ")


def joined_tags(labels: Column) -> Column:
    return F.array_join(labels["tag"], " ")
