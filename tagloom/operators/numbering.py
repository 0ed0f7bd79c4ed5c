"""Contiguous numbers in a total order without a one-partition window over the rows.

Three forms, by what is known about the order:

* ``number_by_bucket`` — the order has a leading bucket of bounded size (hash prefix, key range);
* ``number_by_range`` — any order, any skew: range partitions, written once, then counted;
* ``number_lines`` in ``tagloom.sources.text`` — the order of lines in files.

All of them count small buckets first and add the running totals of those counts to positions
inside each bucket. Only the count table, never the rows, meets a single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.hashing import key_hash
from tagloom.session import materialise


# Fewest rows that a key bucket should hold on average.
SPARSE = 1000


def _before(count: str, window) -> Column:
    """Running total of the rows in front of this one."""
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(earlier), F.lit(0)).cast("bigint")


def number_by_bucket(
    df: DataFrame,
    bucket: Column,
    order: Sequence[Column],
    *,
    group: Sequence[str] = (),
    restart: bool = True,
    name: str = "position",
) -> DataFrame:
    """0-based position in the order ``(group, bucket, order)``.

    ``bucket`` must grow with ``order`` inside a group and split it into parts that one task can
    sort; a hot group is then spread over all its buckets. With ``restart=False`` the numbers
    run on across groups.
    """
    keys = [*group, "_bucket"]
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*group).orderBy("_bucket") if group else Window.orderBy(*keys)
    offsets = counts.select(*keys, _before("_n", running).alias("_offset"))
    if group and not restart:
        # Totals of groups are summed on their own, so no task holds groups times buckets.
        totals = counts.groupBy(*group).agg(F.sum("_n").alias("_n"))
        starts = totals.select(*group, _before("_n", Window.orderBy(*group)).alias("_start"))
        offsets = offsets.join(starts, list(group)).withColumn("_offset", F.col("_offset") + F.col("_start"))
        offsets = offsets.drop("_start")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        keyed.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )


def number_by_key(df: DataFrame, key: str, *, width: int = 1 << 20, name: str = "position") -> DataFrame:
    """Position in the order of a unique integer key; a bucket spans ``width`` key values.

    Keys too sparse for that (hashes, say) would give a bucket per row; they are numbered by range.
    """
    span = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n")).first()
    if span["n"] and (span["high"] - span["low"]) / width > max(1.0, span["n"] / SPARSE):
        return number_by_range(df, [F.col(key)], name=name)
    bucket = F.floor(F.col(key) / F.lit(width)).cast("bigint")
    return number_by_bucket(df, bucket, [F.col(key)], name=name)


def number_by_hash(
    df: DataFrame,
    key: Sequence[Column],
    tie: Sequence[Column],
    *,
    group: Sequence[str] = (),
    restart: bool = True,
    digits: int = 3,
    name: str = "position",
) -> DataFrame:
    """Position in md5 order of ``key``; ``16**digits`` buckets per group."""
    hashed = df.withColumn("_hash", key_hash(*key))
    numbered = number_by_bucket(
        hashed,
        F.substring("_hash", 1, digits),
        [F.col("_hash"), *tie],
        group=group,
        restart=restart,
        name=name,
    )
    return numbered.drop("_hash")


def number_by_range(
    df: DataFrame,
    order: Sequence[Column],
    *,
    group: Sequence[str] = (),
    name: str = "position",
    size_name: str | None = None,
) -> DataFrame:
    """Position per group in any order, for value orders where a hot group or ties defeat buckets.

    ``order`` must break all ties. Rows are range-partitioned on ``(group, order)``, so a hot
    group spans many partitions. The sorted rows are written once because the sampled bounds
    would differ on recomputation. ``size_name`` adds the size of each group.
    """
    sort_key = [*[F.col(g) for g in group], *order]
    arranged = (
        df.repartitionByRange(*sort_key)
        .sortWithinPartitions(*sort_key)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    stored = materialise(arranged, "ordered").withColumn("_part", F.shiftright("_id", 33))
    keys = [*group, "_part"]
    blocks = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    by_group = Window.partitionBy(*group)
    columns = [*keys, "_first", _before("_n", by_group.orderBy("_part")).alias("_offset")]
    if size_name:
        columns.append(F.sum("_n").over(by_group).alias(size_name))
    return (
        stored.join(blocks.select(*columns), keys)
        .withColumn(name, F.col("_offset") + F.col("_id") - F.col("_first"))
        .drop("_id", "_part", "_first", "_offset")
    )
