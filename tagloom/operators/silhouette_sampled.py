"""Euclidean silhouettes in linear work, from samples of bounded expected size.

Sums of distances to all members of a cluster are estimated from a few members, each counted as often as
it stands for others. A member's chance follows its share of the distances (probability proportional to
size): far members weigh most in a sum and are nearly always taken. A few members drawn evenly first (``PILOTS`` per
cluster) measure those shares: the chance of ``e`` is ``min(1, size * max(d(e, p) / W(p), 1 / n))`` with the greatest
ratio over the pilots ``p`` and ``W(p)`` the sum of distances from ``p`` to its cluster. A cluster of up to ``size`` rows is taken
whole, and its sums are exact.

By the triangle inequality no member's share of any row's sum exceeds four times the measured one if a pilot
lies in the nearer half of its cluster. With Bernstein's inequality and ``n`` rows in ``k`` clusters, all
weighted sums, and the weighted numbers of members that they are divided by, are within a relative error
``e = sqrt(12 / size * log(4 n k / delta))`` with probability ``1 - delta``. Mean distances are then within
``error_bound = 2 e / (1 - e)``. In practice errors are many times smaller.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.hashing import DRAW_DIGITS, draw
from tagloom.operators.silhouette import _score
from tagloom.session import materialise

SAMPLE = 1024  # expected rows per cluster and pilot, at most
PILOTS = 8
BLOCK_CELLS = 1 << 20
MOST_BYTES = 256 << 20  # of all samples
SEED = 0


def error_bound(size: int, rows: int, clusters: int, delta: float = 0.05) -> float:
    """Relative error of a mean distance that is not exceeded with probability ``1 - delta``."""
    e = math.sqrt(12 / size * math.log(4 * max(rows, 1) * max(clusters, 1) / delta))
    return 2 * e / (1 - e) if e < 1 else math.inf


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float).reshape(len(vectors), width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squared = np.zeros((len(x), len(y)))
    for dim in range(x.shape[1]):
        gap = x[:, dim, None] - y[None, :, dim]
        squared += gap * gap
    return np.sqrt(squared)


def _uniform(*parts) -> F.Column:
    return draw(*parts) / F.lit(16.0**DRAW_DIGITS)


def _stacked(rows: list, names: list, width: int) -> list[np.ndarray]:
    """Vectors per cluster, in the order of ``names``."""
    return [np.asarray([r["_v"] for r in rows if r["_c"] == c], float).reshape(-1, width) for c in names]


def samples(rows: DataFrame, sizes: list, size: int, seed: int) -> DataFrame:
    """``_c, _v, _weight``: the drawn members and how many each stands for."""
    spark = rows.sparkSession
    names = [r["_c"] for r in sizes]
    width = sizes[0]["width"]
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["_c"]), F.lit(min(1.0, PILOTS / r["n"])))])
    # A second and a third draw decide where the first takes nobody of a cluster.
    first = [rows.filter(_uniform(F.col("_key"), F.lit(f"pilot{k}|{seed}")) < share[F.col("_c")]) for k in range(3)]
    drawn = [f.select("_c", "_v").collect() for f in first[:1]]
    missing = set(names) - {r["_c"] for r in drawn[0]}
    for f in first[1:]:
        if missing:
            drawn.append(f.filter(F.col("_c").isin(list(missing))).select("_c", "_v").collect())
            missing -= {r["_c"] for r in drawn[-1]}
    pilots = _stacked([r for part in drawn for r in part], names, width)
    place = {c: i for i, c in enumerate(names)}
    shared = spark.sparkContext.broadcast(pilots)

    def to_pilots(vectors: pa.Array, clusters: pa.Array) -> pa.Array:
        x, own = _matrix(vectors, width), np.array([place[c] for c in clusters.to_pylist()])
        out: list = [None] * len(x)
        for i in np.unique(own).tolist():
            at = np.flatnonzero(own == i)
            for k, d in zip(at.tolist(), _distances(x[at], shared.value[i])):
                out[k] = d.tolist()
        return pa.array(out, pa.list_(pa.float64()))

    away = F.arrow_udf(to_pilots, "array<double>")(F.col("_v"), F.col("_c"))
    measured = rows.withColumn("_away", away)
    sums = measured.select("_c", F.posexplode("_away").alias("p", "d")).groupBy("_c", "p").agg(F.sum("d").alias("d")).collect()
    total = {c: [0.0] * len(p) for c, p in zip(names, pilots)}
    for r in sums:
        total[r["_c"]][r["p"]] = r["d"]
    totals = F.create_map(*[x for c in names for x in (F.lit(c), F.array(*map(F.lit, total[c])).cast("array<double>"))])
    counts = F.create_map(*[x for r in sizes for x in (F.lit(r["_c"]), F.lit(float(r["n"])))])
    ratio = F.zip_with("_away", totals[F.col("_c")], lambda d, w: F.coalesce(F.try_divide(d, w), F.lit(0.0)))
    part = F.greatest(F.coalesce(F.array_max(ratio), F.lit(0.0)), 1.0 / counts[F.col("_c")])
    chance = F.when(counts[F.col("_c")] <= size, 1.0).otherwise(F.least(F.lit(1.0), part * size))
    with_chance = measured.withColumn("_chance", chance)
    return with_chance.filter(_uniform(F.col("_key"), F.lit(f"member|{seed}")) < F.col("_chance")).select(
        "_c", "_v", (1 / F.col("_chance")).alias("_weight")
    )


def silhouette_sampled(
    points: DataFrame, key: str, vector: str, cluster: str, size: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """``key, cluster, a, b, s`` of every row; rows with a NULL vector or cluster are left out.

    Draws are hashes of the key, so results do not depend on the partitioning. The samples are broadcast
    after their size was checked.
    """
    rows = points.select(F.col(key).alias("_key"), F.col(cluster).alias("_c"), F.col(vector).cast("array<double>").alias("_v"))
    rows = materialise(rows.dropna(subset=["_c", "_v"]), "points")
    sizes = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("width")).orderBy("_c").collect()
    named = rows.select(F.col("_key").alias(key), F.col("_c").alias(cluster), "_v")
    if not sizes:
        empty = [F.lit(None).cast("double").alias(n) for n in ("a", "b")]
        return named.select(key, cluster, *empty, F.lit(0.0).alias("s"))
    names, width = [r["_c"] for r in sizes], sizes[0]["width"]
    taken = materialise(samples(rows, sizes, size, seed), "members")
    if taken.count() * (width + 2) * 8 > MOST_BYTES:
        raise ValueError(f"samples of {size} rows for {len(names)} clusters exceed {MOST_BYTES} bytes; choose a smaller size")
    drawn = taken.collect()
    weights = [np.asarray([r["_weight"] for r in drawn if r["_c"] == c]) for c in names]
    # Chance decides how many rows a sample stands for in all; the cluster's size is known.
    weights = [w * (r["n"] / w.sum()) if len(w) else w for w, r in zip(weights, sizes)]
    shared = rows.sparkSession.sparkContext.broadcast((_stacked(drawn, names, width), weights, np.asarray([float(r["n"]) for r in sizes])))
    place = {c: i for i, c in enumerate(names)}

    def score(vectors: pa.Array, clusters: pa.Array) -> pa.Array:
        members, weight, n = shared.value
        x, own = _matrix(vectors, width), np.array([place[c] for c in clusters.to_pylist()], int)
        sums = np.empty((len(x), len(members)))
        for i, (m, w) in enumerate(zip(members, weight)):
            step = max(1, BLOCK_CELLS // max(1, len(m)))
            for at in range(0, len(x), step):
                sums[at : at + step, i] = _distances(x[at : at + step], m) @ w
        line = np.arange(len(x))
        a = np.where(n[own] > 1, sums[line, own] / np.maximum(n[own] - 1, 1), np.nan)
        means = sums / n
        means[line, own] = np.inf
        b = means.min(1) if len(members) > 1 else np.full(len(x), np.nan)
        return pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in (a, b)], names=["a", "b"])

    measured = named.withColumn("_d", F.arrow_udf(score, "struct<a: double, b: double>")(F.col("_v"), F.col(cluster)))
    return measured.select(key, cluster, "_d.a", "_d.b").withColumn("s", _score(F.col("a"), F.col("b")))
