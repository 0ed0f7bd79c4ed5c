"""Corpora derived from the supplied tables; every one covers its whole source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.tags import label_string, tag_structs
from tagloom.operators.corrections import CORRECTION_SCHEMA
from tagloom.sources.tables import ANALYZERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, sentence``: one tagged sentence per order."""
    key = F.col("o_orderkey")

    def part(condition, *pieces):
        return F.when(condition, F.concat(*pieces)).otherwise(F.lit(""))

    sentence = F.concat(
        F.lit("주문 "),
        key.cast("string"),
        F.lit(" <"),
        F.col("c_name"),
        F.lit(":PS>"),
        part(key % 3 != 0, F.lit("이 <"), F.col("n_name"), F.lit(":LC>에서")),
        part(key % 2 == 0, F.lit(" <"), F.col("o_orderdate").cast("date").cast("string"), F.lit(":DT>에!! ")),
        part(key % 5 == 0, F.lit(" <"), (key % 24).cast("string"), F.lit("시:TI>쯤")),
        part(key % 7 < 3, F.lit(" <"), F.col("c_mktsegment"), F.lit(":OG> 부문")),
        part(key % 4 == 1, F.lit(" (<"), (key % 1000).cast("string"), F.lit("개:QT>)")),
        F.lit(" 샀다~~"),
    )
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(key.alias("row_id"), sentence.alias("sentence"))
    )


def in_test_part() -> Column:
    """About 3/16 of the rows, by hash."""
    return F.substring(F.md5(F.concat(F.col("row_id").cast("string"), F.lit("|split"))), 1, 1) < "3"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, label, pred``: gold label strings and damaged copies of them."""
    rows = tagged(spark, sf_dir).withColumn("labels", tag_structs(F.col("sentence")))
    rows = rows.select("row_id", label_string(F.col("labels")).alias("label"))
    label = F.col("label")
    pred = (
        F.when(F.col("row_id") % 11 == 0, F.lit("none"))
        .when(F.col("row_id") % 7 == 0, F.replace(label, F.lit(":LC"), F.lit(":OG")))
        .when(F.col("row_id") % 5 == 0, F.concat(F.lit("x "), label, F.lit(" 외:PS")))
        .when(F.col("row_id") % 9 == 0, F.replace(label, F.lit(" "), F.lit("  ")))
        .otherwise(label)
    )
    return rows.withColumn("pred", pred)


def bleu_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, label, pred`` from whole conversation turns."""
    label = F.col("text")
    row_id = F.col("conv_id") * 100 + F.col("turn")
    pred = (
        F.when(row_id % 3 == 0, F.replace(label, F.lit("an"), F.lit("on")))
        .when(row_id % 7 == 0, F.lit("a b"))
        .otherwise(label)
    )
    return table(spark, sf_dir, "conversations").select(
        row_id.alias("row_id"), label.alias("label"), pred.alias("pred")
    )


def noun_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and one noun array per analyzer; the analyzers differ in the shortest noun."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    rows = documents(spark, sf_dir).select("doc_id", words.alias("words"))

    def at_least(n: int) -> Column:
        return F.filter("words", lambda w: F.char_length(w) >= n)

    nouns = [at_least(n).alias(f"{a}_nouns") for n, a in enumerate(ANALYZERS, start=2)]
    return rows.select("doc_id", *nouns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    )


def corrections(spark: SparkSession) -> DataFrame:
    """One correction that applies and one for a row that does not exist."""
    rows = [(5, "<5시:TI>", "<다섯 시:TI>"), (-1, "x", "y")]
    return spark.createDataFrame(rows, CORRECTION_SCHEMA)
