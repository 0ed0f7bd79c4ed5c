"""CSV files with line breaks inside quotes, read by all cores.

A quote character either encloses a field or is doubled inside one, so a line break lies inside a field
exactly if the number of quotes before it in the file is odd. The first pass counts quotes per file
split; running totals over the table of splits tell in which state each split begins. The second pass
streams the lines of every split from that state and puts records together. Only records that cross a
border between splits are shuffled, as one piece per split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import materialise

QUOTE = '"'
# Splits that begin inside a field are broadcast: file and offset, some 200 bytes each.
MOST_OPEN_SPLITS = 500_000
PIECES = "file string, start bigint, id bigint, whole boolean, head boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )


def _open_splits(lines: DataFrame) -> set[tuple[str, int]]:
    """Splits that begin inside a quoted field."""
    quotes = F.length("text") - F.length(F.replace("text", F.lit(QUOTE), F.lit("")))
    counts = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("before", F.sum("n").over(earlier)).filter("before % 2 = 1")
    found = begun.select("file", "start").limit(MOST_OPEN_SPLITS + 1).collect()
    if len(found) > MOST_OPEN_SPLITS:
        raise ValueError(f"more than {MOST_OPEN_SPLITS} file splits begin inside a quoted field")
    return {(r["file"], r["start"]) for r in found}


def _pieces(lines: DataFrame) -> DataFrame:
    """Whole records, and the parts of records that cross a border; ``head``: the part begins a record."""
    opened = lines.sparkSession.sparkContext.broadcast(_open_splits(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        split, first, held, head, inside = None, 0, [], True, False

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows = []
            for text, *own, line in zip(*[batch[c].to_pylist() for c in ("text", "file", "start", "id")]):
                if own != split:
                    if held:
                        rows.append((*split, first, False, head, "\n".join(held)))
                    split, held = own, []
                    inside = tuple(own) in opened.value
                    head = not inside
                if not held:
                    first = line
                held.append(text)
                inside ^= text.count(QUOTE) % 2 == 1
                if not inside:
                    rows.append((*split, first, head, head, "\n".join(held)))
                    held, head = [], True
            if rows:
                yield made(rows)
        if held:
            yield made([(*split, first, False, head, "\n".join(held))])

    return lines.mapInArrow(run, PIECES)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, id, text``: the records of all files, header included; ``(file, start, id)`` is their order."""
    pieces = materialise(_pieces(_lines(spark, path)), "csv-pieces")
    by_file = Window.partitionBy("file").orderBy("start", "id")
    # A part that begins no record continues the record begun last.
    owner = F.last(F.when(F.col("head"), F.struct("start", "id")), ignorenulls=True).over(by_file)
    parts = pieces.filter("NOT whole").withColumn("owner", owner)
    ordered = F.array_sort(F.collect_list(F.struct("start", "id", "text")))
    joined = parts.groupBy("file", "owner").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))
    crossing = joined.select("file", "owner.start", "owner.id", "text")
    records = pieces.filter("whole").select("file", "start", "id", "text").unionByName(crossing)
    return records.withColumn("text", F.regexp_replace("text", r"\r\z", "")).filter("text <> ''")


def read_quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` by name, like ``read_csv`` with ``multi_line``, from files of any split.

    Every file has the same header, without line breaks.
    """
    header = spark.read.csv(path, header=True, escape=QUOTE).columns
    wanted = T.StructType.fromDDL(schema)
    missing = [f.name for f in wanted.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    records = csv_records(spark, path)
    # The header is the record at the start of a file: its first split, and the least id in it.
    firsts = materialise(
        records.groupBy("file").agg(F.min(F.struct("start", "id")).alias("first")).select("file", "first.start", "first.id"), "headers"
    )
    rows = records.join(firsts, ["file", "start", "id"], "left_anti")
    layout = ", ".join(f"`_{i}` string" for i in range(len(header)))
    parsed = rows.select(F.from_csv("text", layout, {"escape": QUOTE, "multiLine": "true"}).alias("row"))
    return parsed.select(
        *[F.col(f"row._{header.index(f.name)}").cast(f.dataType).alias(f.name) for f in wanted.fields]
    )
