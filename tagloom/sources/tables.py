"""CSV sources with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.numbering import number_by_key
from tagloom.session import materialise

# The noun columns of the analysed corpus.
ANALYZERS = ("kkma", "hannanum", "komoran", "mecab", "okt")


# A printed string in either kind of quotes, with backslash escapes; group 1 is what the quotes enclose.
PRINTED = r"""['"]((?<=')(?:[^'\\]++|\\.)*+(?=')|(?<=")(?:[^"\\]++|\\.)*+(?="))['"]"""


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """The columns of ``schema`` from a CSV file with header, selected by name and cast.

    Further columns and another order do not matter; a missing column is an error. With
    ``multi_line`` quoted fields may hold line breaks, but then a file cannot be split.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    wanted = T.StructType.fromDDL(schema)
    missing = [f.name for f in wanted.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields])


def read_keyed_csv(spark: SparkSession, path: str, key: str, schema: str, multi_line: bool = False) -> DataFrame:
    """The same with an integer key in front: the file's own, or else the number of the row."""
    header = spark.read.csv(path, header=True, multiLine=multi_line, escape='"').columns
    if key in header:
        return read_csv(spark, path, f"{key} long, {schema}", multi_line)
    rows = read_csv(spark, path, schema, multi_line).withColumn("_order", F.monotonically_increasing_id())
    numbered = number_by_key(materialise(rows, "csv"), "_order", name=key)
    return numbered.select(key, *[c for c in rows.columns if c != "_order"])


def read_tagged_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``row_id, sentence``; rows are numbered where the file has no ``row_id``."""
    return read_keyed_csv(spark, path, "row_id", "sentence string", multi_line)


def parse_list(cell):
    """A list printed as ``['a', "b'c"]`` back to an array; empty strings are left out."""
    items = F.regexp_extract_all(cell, F.lit(PRINTED), F.lit(1))
    # Few cells hold a backslash; only their items are searched by pattern one by one.
    bare = F.transform(items, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
    return F.array_remove(F.when(F.contains(cell, F.lit("\\")), bare).otherwise(items), "")


def noun_documents(wide: DataFrame, analyzers: Sequence[str] = ANALYZERS) -> DataFrame:
    """``doc_id, analyzer, nouns``: one row per document and analyzer."""
    return wide.unpivot(
        "doc_id", [F.col(f"{a}_nouns").alias(a) for a in analyzers], "analyzer", "nouns"
    )


def read_noun_csv(spark: SparkSession, path: str, analyzers: Sequence[str] = ANALYZERS) -> DataFrame:
    """The wide noun file, its cells parsed to arrays once."""
    columns = ", ".join(f"{a}_nouns string" for a in analyzers)
    raw = read_keyed_csv(spark, path, "doc_id", columns)
    return raw.select("doc_id", *[parse_list(F.col(f"{a}_nouns")).alias(f"{a}_nouns") for a in analyzers])
