"""Silhouette values.

``silhouette_squared`` uses squared Euclidean distance and per-cluster sums: linear in the rows,
the form for large data. ``silhouette_exact`` uses Euclidean distance, which has no such closed
form: every pair has to be measured. It does so in tiles of bounded size and emits per-row sums,
never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.numbering import number_by_range

BLOCK_ROWS = 2048
BLOCK_BYTES = 16 << 20  # of the vectors of a larger block
MOST_BLOCKS = 32  # blocks grow up to ``BLOCK_BYTES`` before there are more of them
STRIP_ROWS = 128  # rows of a tile that are measured at once
CANCELLED = 1e-5  # squared distances up to this share of the squared lengths are measured again
AGAIN_PAIRS = 1 << 14
MOST_BYTES = 256 << 20  # of the table of clusters


def _score(own: Column, nearest: Column) -> Column:
    """``(b - a) / max(a, b)``; 0 for a cluster of one (``own`` is NULL) and where both are 0."""
    return F.coalesce(F.try_divide(nearest - own, F.greatest(own, nearest)), F.lit(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _cluster_sums(points: DataFrame, vector: str, cluster: str) -> list:
    """``cluster, n, squares, total`` of every cluster, in order: the size of a k-means model."""
    x = F.col(vector)
    sums = points.select(cluster, F.posexplode(vector).alias("dim", "x"))
    sums = sums.groupBy(cluster, "dim").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy(cluster).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("total")
    )
    sizes = points.groupBy(cluster).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(_dot(x, x)).alias("squares")
    )
    return sizes.join(vectors, cluster).orderBy(cluster).collect()


def silhouette_squared(points: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """Adds ``a, b, s`` per row: mean squared distance to the own and to the nearest other cluster.

    Rows with a NULL vector or cluster have NULL scores and are part of no cluster. The cluster table is
    broadcast after its size was checked; rows are scored in blocks against all of it.
    """
    stats = _cluster_sums(points.dropna(subset=[vector, cluster]), vector, cluster)
    width = len(stats[0]["total"]) if stats else 0
    if len(stats) * (width + 2) * 8 > MOST_BYTES:
        raise ValueError(f"{len(stats)} clusters of {width} dimensions exceed {MOST_BYTES} bytes")
    shared = points.sparkSession.sparkContext.broadcast(
        (
            {r[cluster]: i for i, r in enumerate(stats)},
            np.asarray([r["n"] for r in stats]),
            np.asarray([r["squares"] for r in stats]),
            np.asarray([r["total"] for r in stats]).reshape(len(stats), width),
        )
    )

    def distances(vectors: pa.Array, clusters: pa.Array) -> pa.Array:
        place, n, squares, total = shared.value
        rows_in = len(vectors)
        usable = np.flatnonzero(pc.and_(vectors.is_valid(), clusters.is_valid()).to_numpy(zero_copy_only=False))
        vectors, clusters = vectors.take(pa.array(usable)), clusters.take(pa.array(usable))
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float).reshape(len(vectors), width)
        own = np.asarray([place[c] for c in clusters.to_pylist()], int)
        a, b = np.full(len(x), np.nan), np.full(len(x), np.nan)
        for i in range(0, len(x), BLOCK_ROWS):
            part, mine = x[i : i + BLOCK_ROWS], own[i : i + BLOCK_ROWS]
            rows = np.arange(len(part))
            # Sum of squared distances to all members; the row itself adds 0 to its own cluster.
            d = np.maximum(np.outer((part * part).sum(1), n) + squares - 2.0 * (part @ total.T), 0.0)
            a[i : i + BLOCK_ROWS] = np.where(n[mine] > 1, d[rows, mine] / np.maximum(n[mine] - 1, 1), np.nan)
            d /= n
            d[rows, mine] = np.inf
            nearest = d.min(axis=1)
            b[i : i + BLOCK_ROWS] = np.where(np.isinf(nearest), np.nan, nearest)
        whole = np.full((2, rows_in), np.nan)
        whole[:, usable] = a, b
        return pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in whole], names=["a", "b"])

    measured = F.arrow_udf(distances, "struct<a: double, b: double>")(F.col(vector), F.col(cluster))
    scored = F.col(vector).isNotNull() & F.col(cluster).isNotNull()
    return (
        points.withColumn("_d", measured)
        .withColumns({"a": F.col("_d.a"), "b": F.col("_d.b")})
        .drop("_d")
        .withColumn("s", F.when(scored, _score(F.col("a"), F.col("b"))))
    )


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two blocks, by one matrix product.

    The product loses digits where a distance is small beside the vectors; those pairs, and pairs
    without a finite distance, are measured again by their differences.
    """
    sizes = (left * left).sum(1)[:, None] + (right * right).sum(1)
    squared = left @ right.T
    squared *= -2.0
    squared += sizes
    sizes *= CANCELLED
    i, j = np.nonzero(~(squared > sizes))
    for at in range(0, len(i), AGAIN_PAIRS):
        some = slice(at, at + AGAIN_PAIRS)
        gap = left[i[some]] - right[j[some]]
        squared[i[some], j[some]] = (gap * gap).sum(1)
    return np.sqrt(squared, out=squared)


def _tile_sums(members: list[list[int]]):
    """Kernel of one tile: for every row the sum of distances to the members of each cluster
    on the other side of the tile."""

    def matrix(lists: pa.ChunkedArray, kind: type) -> np.ndarray:
        values = np.asarray([] if not len(lists) else lists.combine_chunks().flatten().to_numpy(zero_copy_only=False), kind)
        return values.reshape(len(lists), -1)

    def one_hot(labels: np.ndarray) -> np.ndarray:
        columns = [labels[:, sweep] == value for sweep, value in members]
        return np.stack(columns, axis=1).astype(float)

    def result(keys: pa.ChunkedArray, sums: np.ndarray) -> pa.Table:
        offsets = np.arange(len(keys) + 1, dtype=np.int32) * len(members)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel(), pa.float64()))
        return pa.table({"_key": keys, "sums": lists})

    def run(tile: pa.Table) -> pa.Table:
        low = tile.filter(pc.equal(tile["_block"], tile["_low"]))
        high = tile.filter(pc.equal(tile["_block"], tile["_high"]))
        if not len(low) or not len(high):
            return result(tile["_key"].slice(0, 0), np.zeros((0, len(members))))
        if low["_vector"].null_count or high["_vector"].null_count:
            raise ValueError("a row has no vector")
        a, b = matrix(low["_vector"], float), matrix(high["_vector"], float)
        la, lb = one_hot(matrix(low["labels"], int)), one_hot(matrix(high["labels"], int))
        # Distances do not change with the origin; near the rows fewer digits cancel.
        origin = a.mean(axis=0)
        if np.isfinite(origin).all():
            a, b = a - origin, b - origin
        to_right, to_left = np.empty((len(a), len(members))), np.zeros((len(b), len(members)))
        mirrored = tile["_low"][0].as_py() != tile["_high"][0].as_py()
        for at in range(0, len(a), STRIP_ROWS):
            d = _distances(a[at : at + STRIP_ROWS], b)
            to_right[at : at + STRIP_ROWS] = d @ lb
            if mirrored:
                to_left += d.T @ la[at : at + STRIP_ROWS]
        found = result(low["_key"], to_right)
        return pa.concat_tables([found, result(high["_key"], to_left)]) if mirrored else found

    return run


def silhouette_exact(
    points: DataFrame, key: str, vector: str, block_rows: int | None = None
) -> DataFrame:
    """``key, labelling, cluster, a, b, s`` for every row and each of its ``labels``.

    Rows are hashed into blocks of about ``block_rows``; a tile is a pair of blocks and measures
    each pair once, for all labellings together. A task holds two blocks, whatever the clusters
    look like. Every row is sent to each block once, so blocks grow with the rows as far as their
    bytes allow. The work is quadratic by definition; use ``silhouette_squared`` beyond that.
    """
    clusters = (
        points.select(F.size(vector).alias("_width"), F.posexplode("labels").alias("labelling", "cluster"))
        .groupBy("labelling", "cluster")
        .agg(F.count(F.lit(1)).alias("n"), F.max("_width").alias("width"))
    )
    table = sorted(clusters.collect())
    members = [[r["labelling"], r["cluster"]] for r in table]
    n_labellings = 1 + max((labelling for labelling, _ in members), default=0)
    n_rows = sum(r["n"] for r in table if r["labelling"] == 0)
    if block_rows is None:
        widest = max((r["width"] or 1 for r in table), default=1)
        block_rows = max(BLOCK_ROWS, min(n_rows // MOST_BLOCKS, BLOCK_BYTES // (8 * max(widest, 1))))
    n_blocks = max(1, -(-n_rows // block_rows))

    blocks = points.select(
        F.col(key).alias("_key"),
        F.col(vector).cast("array<double>").alias("_vector"),
        "labels",
        F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("_block"),
    )
    tiles = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        "_key",
        "_vector",
        "labels",
        "_block",
        F.least("_block", "_other").alias("_low"),
        F.greatest("_block", "_other").alias("_high"),
    )
    key_type = points.schema[key].dataType.simpleString()
    partial = tiles.groupBy("_low", "_high").applyInArrow(
        _tile_sums(members), f"_key {key_type}, sums array<double>"
    )
    sums = partial.groupBy("_key").agg(
        F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(len(members))]).alias("sums")
    )
    known = F.array(
        *[
            F.struct(
                F.lit(r["labelling"]).alias("labelling"),
                F.lit(r["cluster"]).alias("cluster"),
                F.lit(float(r["n"])).alias("n"),
            )
            for r in table
        ]
    )
    per_cluster = F.zip_with(
        known,
        "sums",
        lambda c, d: F.struct(
            c["labelling"].alias("labelling"), c["cluster"].alias("cluster"), c["n"].alias("n"), d.alias("d")
        ),
    )
    labelled = points.select(
        F.col(key).alias("_key"), F.posexplode("labels").alias("labelling", "cluster")
    )
    scored = (
        sums.select("_key", per_cluster.alias("_d"))
        .select("_key", "_d", F.explode(F.sequence(F.lit(0), F.lit(n_labellings - 1))).alias("labelling"))
        .join(labelled, ["_key", "labelling"])
    )
    same = F.filter("_d", lambda c: c["labelling"] == F.col("labelling"))
    own = F.get(F.filter("_same", lambda c: c["cluster"] == F.col("cluster")), F.lit(0))
    others = F.filter("_same", lambda c: c["cluster"] != F.col("cluster"))
    return (
        scored.withColumn("_same", same)
        .withColumn("a", own["d"] / F.nullif(own["n"] - 1, F.lit(0.0)))
        .withColumn("b", F.array_min(F.transform(others, lambda c: c["d"] / c["n"])))
        .select(
            F.col("_key").alias(key), "labelling", "cluster", "a", "b", _score(F.col("a"), F.col("b")).alias("s")
        )
    )


def silhouette_profile(scored: DataFrame, group: list[str], key: str) -> DataFrame:
    """Rows numbered by ascending ``s`` in each group, with the group's size: the table behind a
    silhouette plot. A group may hold most of the rows, so it is numbered by range."""
    order = [F.col("s"), F.col(key)]
    return number_by_range(scored, order, group=group, name="position", size_name="cluster_size")
