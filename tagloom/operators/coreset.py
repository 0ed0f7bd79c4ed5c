"""k-means for many k from one weighted sample.

A row is drawn with a chance that is half its even share and half its share of the squared distances to
the mean of all rows, and weighs the inverse of its chance. The weighted cost of any set of centres then differs from
the cost over all rows by at most ``e / 2`` of it plus ``e / 2`` of the cost of one centre, with ``e`` falling as
one over the root of ``size``. The sample is drawn once, in one pass after the mean, and serves every k; fits
read the sample only, and one more pass over all rows gives labels and exact costs for every k together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.hashing import DRAW_DIGITS, draw
from tagloom.operators.cluster import MAX_ITER, SEED, SWEEP
from tagloom.session import materialise

SIZE = 20_000  # expected rows of a coreset
BLOCK_CELLS = 1 << 20


def coreset(points: DataFrame, key: str, vector: str, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """``point, weight``: about ``size`` rows that stand for all. Draws are hashes of the key.

    Rows with a NULL vector are left out. With fewer rows than ``size`` every row may be taken, with weight 1.
    """
    rows = points.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).dropna(subset=["_v"])
    means = rows.select(F.posexplode("_v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    found = sorted(means.collect())
    if not found:
        return rows.select(F.col("_v").alias("point"), F.lit(1.0).alias("weight"))
    n = max(r["n"] for r in found)
    mean = F.array(*[F.lit(float(r["x"])) for r in found])
    away = F.aggregate(F.zip_with("_v", mean, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    measured = rows.withColumn("_away", away)
    spread = measured.agg(F.coalesce(F.sum("_away"), F.lit(0.0))).first()[0]
    share = F.col("_away") / F.lit(spread) if spread > 0 else F.lit(1.0 / n)
    chance = F.least(F.lit(1.0), size * (0.5 / n + 0.5 * share))
    drawn = measured.withColumn("_chance", chance)
    if n <= size:
        drawn = drawn.withColumn("_chance", F.lit(1.0))
    uniform = draw(F.col("_key"), F.lit(f"coreset|{seed}")) / F.lit(16.0**DRAW_DIGITS)
    return drawn.filter(uniform < F.col("_chance")).select(F.col("_v").alias("point"), (1 / F.col("_chance")).alias("weight"))


def fit_centres(sample: DataFrame, ks: Sequence[int] = SWEEP, max_iter: int = MAX_ITER, seed: int = SEED) -> dict[int, np.ndarray]:
    """Centres for every k, from the sample alone."""
    frame = materialise(sample, "coreset").withColumn("_in", array_to_vector(F.col("point")))
    fits = {}
    for k in ks:
        model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_in", weightCol="weight").fit(frame)
        fits[k] = np.asarray(model.clusterCenters(), float)
    return fits


def label_all(points: DataFrame, vector: str, fits: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``labels`` and ``costs``: nearest centre and squared distance to it for each k, in one narrow pass."""
    shared = points.sparkSession.sparkContext.broadcast(list(fits.values()))

    def run(vectors: pa.Array) -> pa.Array:
        whole = vectors.drop_null()
        x = np.asarray(whole.flatten().to_numpy(zero_copy_only=False), float).reshape(len(whole), -1)
        labels, costs = (np.empty((len(x), len(shared.value)), kind) for kind in (int, float))
        for j, centres in enumerate(shared.value):
            step = max(1, BLOCK_CELLS // max(1, centres.size))
            for at in range(0, len(x), step):
                gap = x[at : at + step, None, :] - centres[None]
                d = (gap * gap).sum(2)
                labels[at : at + step, j], costs[at : at + step, j] = d.argmin(1), d.min(1)
        made = iter(zip(labels.tolist(), costs.tolist()))
        rows = [dict(zip(("labels", "costs"), next(made))) if v else None for v in vectors.is_valid().to_pylist()]
        return pa.array(rows, pa.struct([("labels", pa.list_(pa.int32())), ("costs", pa.list_(pa.float64()))]))

    found = F.arrow_udf(run, "struct<labels: array<int>, costs: array<double>>")(F.col(vector))
    return points.withColumn("_fit", found).withColumns({"labels": F.col("_fit.labels"), "costs": F.col("_fit.costs")}).drop("_fit")


def sweep_costs(labelled: DataFrame, ks: Sequence[int] = SWEEP) -> DataFrame:
    """``k, n_rows, cost``: the sum of squared distances over all rows."""
    costs = labelled.select(F.posexplode("costs").alias("i", "cost")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("cost").alias("cost")
    )
    return costs.select(F.get(F.array(*map(F.lit, ks)), F.col("i")).alias("k"), "n_rows", "cost")
