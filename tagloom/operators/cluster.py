"""Two-dimensional reduction, k-means and its sweep over k."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import materialise

# The sweep of the published analysis.
SWEEP = (2, 3, 4, 5, 6, 7)
MAX_ITER = 500
SEED = 0

BLOCK_CELLS = 1 << 20
MOST_BYTES = 256 << 20  # of a table of centres


def pca_2d(points: DataFrame, key: str = "vec_id") -> DataFrame:
    """``key, point``: the first two principal components of ``embedding`` (sign is arbitrary)."""
    frame = points.select(key, array_to_vector(F.col("embedding")).alias("_in"))
    model = PCA(k=2, inputCol="_in", outputCol="_out").fit(frame)
    return model.transform(frame).select(key, vector_to_array("_out").alias("point"))


def svd_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """``width x 2``: the leading right singular vectors of sparse ``features``.

    The solver multiplies the distributed matrix by single vectors, so the driver holds two
    columns of vocabulary length and never a width x width matrix; its passes read the rows from
    memory or disk. A matrix of rank below two leaves the other column 0.
    """
    axes = np.zeros((width, 2))
    rows = MLUtils.convertVectorColumnsFromML(vectors.select("features"), "features").persist(StorageLevel.MEMORY_AND_DISK)
    if not width or rows.isEmpty():
        return axes
    found = RowMatrix(rows).computeSVD(min(2, width)).V.toArray()
    rows.unpersist()
    axes[:, : found.shape[1]] = found
    return axes


def kmeans_labels(
    points: DataFrame, ks: Sequence[int] = SWEEP, max_iter: int = MAX_ITER, seed: int = SEED
) -> DataFrame:
    """Adds ``labels``: the cluster of every row for each k, in the order of ``ks``.

    The 2-D points are written once, since every fit reads them; k-means caches its own input
    while it iterates. All fitted models then label the rows in one narrow pass.
    """
    frame = materialise(points, "points").withColumn("_in", array_to_vector(F.col("point")))
    labelled = frame
    for k in ks:
        model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_in", predictionCol=f"_k{k}").fit(frame)
        labelled = model.transform(labelled)
    return labelled.withColumn("labels", F.array(*[F.col(f"_k{k}") for k in ks])).drop(
        "_in", *[f"_k{k}" for k in ks]
    )


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cluster_means(points: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, centre``: the mean vector of every cluster, summed map-side per dimension."""
    spread = points.select(key, F.posexplode(vector).alias("dim", "x"))
    means = spread.groupBy(key, "dim").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("dim", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda c: c["x"]).alias("centre"))


def assign_to_centres(points: DataFrame, centres: DataFrame, vector: str) -> DataFrame:
    """Adds ``cluster``: the nearest fixed centre, the smaller label on ties.

    Like a k-means model, the centres are broadcast, after their size was checked. Distances are summed by dimension in blocks of
    bounded size, so ties do not depend on the block.
    """
    key, value = centres.columns
    size = centres.agg(F.sum(F.size(value)) * 8).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"centres of {size} bytes exceed {MOST_BYTES}")
    rows = centres.orderBy(key).collect()
    kind = centres.schema[key].dataType
    labels = [r[key] for r in rows]
    shared = points.sparkSession.sparkContext.broadcast(np.asarray([r[value] for r in rows], float).reshape(len(rows), -1))

    def nearest(vectors: pa.Array) -> pa.Array:
        table = shared.value
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float).reshape(len(vectors), table.shape[1])
        step = max(1, BLOCK_CELLS // max(1, len(table)))
        best = np.empty(len(x), int)
        for i in range(0, len(x), step):
            d = np.zeros((len(x[i : i + step]), len(table)))
            for dim in range(table.shape[1]):
                d += (x[i : i + step, dim, None] - table[None, :, dim]) ** 2
            best[i : i + step] = d.argmin(axis=1)
        return pa.array(best)

    place = F.arrow_udf(nearest, "bigint")(F.col(vector)).cast("int")
    return points.withColumn("cluster", F.get(F.lit(labels).cast(T.ArrayType(kind)), place))


def centre_update(points: DataFrame, centres: DataFrame, vector: str) -> DataFrame:
    """``cluster, centre``: means of the rows nearest to each given centre, one step of k-means."""
    return cluster_means(assign_to_centres(points, centres, vector), "cluster", vector)
