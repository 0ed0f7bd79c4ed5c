"""Nearest-neighbour graph by NN-descent, and a two-dimensional layout that keeps neighbourhoods.

The graph starts from random neighbours and gets better by the rule that neighbours of neighbours are
likely neighbours: in a round every row compares the rows that it is linked with, in either direction, among
each other, and each of them learns of closer ones. Only links that changed in the round before lead to
new comparisons. A row takes part with at most ``2 * k`` partners per round, drawn evenly from the
rows that link to it, so rows that very many others link to stay cheap. Hosts are compared in parts of bounded
size, and a part gets a vector once, however many of its hosts are linked with it.

The layout starts from two principal components. Links pull their ends together, weighted by how close they are
on the scale of the row's own neighbourhood; rows drawn anew in each epoch push all others away.

Rounds and epochs are Spark jobs over stored tables. Rows with a NULL vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.hashing import key_hash
from tagloom.operators.cluster import pca_2d
from tagloom.operators.numbering import number_by_hash
from tagloom.session import materialise

K = 15
ROUNDS = 8
SETTLED = 0.002  # share of links that may still change at the end
EPOCHS = 20
NEGATIVES = 512  # rows that push in an epoch
PUSH = 5.0  # pushes per pull
# The published curve of the layout for a least distance of 0.1.
CURVE_A, CURVE_B = 1.577, 0.895
MOST_STEP = 4.0
PAIR_CELLS = 1 << 18  # numbers of a block of pairs
MEMBER_ROWS = 1 << 14  # members that are compared at a time
FOUND_ROWS = 1 << 21  # new links that a part keeps before it drops the farther ones
PART_BYTES = 320 << 20  # vectors and members of a part
MEMBER_BYTES = 64  # of a member's ids and of what is found for it
SEED = 0

LINK = "node bigint, neighbour bigint, distance double"


def _nodes(points: DataFrame, key: str, vector: str) -> DataFrame:
    """``node, _key, _v``: dense numbers in hash order, so that following numbers are random rows."""
    rows = points.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).dropna(subset=["_v"])
    return materialise(number_by_hash(rows, [F.col("_key"), F.lit(SEED)], [F.col("_key")], name="node"), "nodes")


def _best(links: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node; a link that is already known keeps its mark."""
    # One exchange by node serves both the grouping and the ranks.
    single = links.repartition("node").groupBy("node", "neighbour").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("distance", "neighbour"))
    return single.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _packed(nodes: DataFrame) -> DataFrame:
    """The vectors as floats where that loses nothing: half the bytes of every shuffle."""
    whole = F.forall("_v", lambda x: x.isNull() | (x.cast("float").cast("double") == x))
    return nodes.withColumn("_v", F.col("_v").cast("array<float>")) if nodes.filter(~whole).isEmpty() else nodes


def _members(links: DataFrame, nodes: DataFrame, k: int, turn: int, size: int = 1, parts: int = 0) -> DataFrame:
    """``part, host, node, fresh``: for every host with a fresh link the rows it is linked with, and itself.

    A part is ``size`` hosts that follow each other; all its rows are in one task, after a single exchange.
    """
    forward = links.select(F.col("node").alias("host"), F.col("neighbour").alias("node"), "fresh", F.lit(False).alias("_back"))
    back = links.select(F.col("neighbour").alias("host"), "node", "fresh", F.lit(True).alias("_back"))
    itself = nodes.select(F.col("node").alias("host"), "node", F.lit(False).alias("fresh"), F.lit(False).alias("_back"))
    every = forward.unionByName(back).unionByName(itself).withColumn("part", F.floor(F.col("host") / F.lit(size)))
    every = every.repartition(parts, "part") if parts else every.repartition("part")
    drawn = F.row_number().over(Window.partitionBy("part", "host", "_back").orderBy(F.xxhash64("node", F.lit(turn))))
    every = every.withColumn("_rank", drawn).filter(~F.col("_back") | (F.col("_rank") <= k))
    # Without a fresh link there is nothing to compare, so no vectors are sent.
    live = every.withColumn("_live", F.max("fresh").over(Window.partitionBy("part", "host"))).filter("_live")
    return live.groupBy("part", "host", "node").agg(F.max("fresh").alias("fresh"))


def _pairs(sizes: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with a fresh row among groups of consecutive rows."""
    shapes: dict[int, tuple] = {}
    firsts, seconds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
        if size not in shapes:
            shapes[size] = np.triu_indices(size, 1)
        i, j = shapes[size]
        firsts.append(i + at)
        seconds.append(j + at)
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    useful = fresh[i] | fresh[j]
    return i[useful], j[useful]


def _nearest(own: np.ndarray, other: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest others of each row, every pair once."""
    order = np.lexsort((other, d, own))
    own, other, d = own[order], other[order], d[order]
    once = np.ones(len(own), bool)
    once[1:] = (own[1:] != own[:-1]) | (other[1:] != other[:-1])
    own, other, d = own[once], other[once], d[once]
    near = np.arange(len(own)) - np.searchsorted(own, own) < k
    return own[near], other[near], d[near]


def _closer(
    hosts: np.ndarray, nodes: np.ndarray, fresh: np.ndarray, worst: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New links among members of the same host, which follow each other, closer than the worst that their node has."""
    starts = np.flatnonzero(np.concatenate(([True], hosts[1:] != hosts[:-1])))
    i, j = _pairs(np.diff(np.append(starts, len(hosts))), fresh)
    d = np.empty(len(i))
    step = max(1, PAIR_CELLS // max(1, vectors.shape[1]))
    for at in range(0, len(i), step):
        gaps = vectors[i[at : at + step]] - vectors[j[at : at + step]]
        d[at : at + step] = np.sqrt((gaps * gaps).sum(1))
    closer, back = d < worst[i], d < worst[j]
    own, other = np.concatenate((i[closer], j[back])), np.concatenate((j[closer], i[back]))
    return _nearest(nodes[own], nodes[other], np.concatenate((d[closer], d[back])), k)


def _matrix(lists: pa.Array) -> np.ndarray:
    """The vectors as rows; a null number is NaN."""
    width = len(lists[0])
    if pc.any(pc.not_equal(pc.list_value_length(lists), width)).as_py():
        raise ValueError("vectors differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _compare(members: DataFrame, k: int) -> DataFrame:
    """New links by ``_closer`` where every member carries its vector; one host's members at a time, ``2 * k + 1`` at most."""

    def found(*rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _closer(*rows, k)], names=["node", "neighbour", "distance"])

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [*[batch[c].to_numpy(zero_copy_only=False) for c in ("host", "node", "fresh", "worst")], _matrix(batch["_v"]).astype(float)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the members of the last host, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            rows = columns(batch)
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows)]
            last = np.searchsorted(rows[0], rows[0][-1])
            held = [c[last:] for c in rows]
            if last:
                yield found(*[c[:last] for c in rows])
        if held is not None:
            yield found(*held)

    return members.repartition("host").sortWithinPartitions("host", "node").mapInArrow(run, LINK)


def _compare_parts(members: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """As ``_compare``, but a part of the hosts gets each of its vectors once, from ``rows``: ``node, worst, _v``."""

    def run(key: tuple, ids: pa.Table, table: pa.Table) -> pa.Table:
        known = table["_node"].to_numpy()
        order = np.argsort(known)
        known, worst = known[order], table["worst"].to_numpy()[order]
        vectors = _matrix(table["_v"].combine_chunks())
        hosts, nodes, fresh = (ids[c].to_numpy() for c in ("host", "node", "fresh"))
        by_host = np.lexsort((nodes, hosts))
        hosts, nodes, fresh = hosts[by_host], nodes[by_host], fresh[by_host]
        found, held, at = [], 0, 0
        while at < len(hosts):
            end = np.searchsorted(hosts, hosts[min(at + MEMBER_ROWS, len(hosts) - 1)], "right")
            place = np.searchsorted(known, nodes[at:end])
            found.append(_closer(hosts[at:end], nodes[at:end], fresh[at:end], worst[place], vectors[order[place]].astype(float), k))
            held += len(found[-1][0])
            if held > FOUND_ROWS:
                found = [_nearest(*[np.concatenate(c) for c in zip(*found)], k)]
                held = len(found[0][0]) // 2  # the next time after as many new ones at least
            at = end
        found = _nearest(*[np.concatenate(c) for c in zip(*found)], k)
        return pa.table([pa.array(c) for c in found], names=["node", "neighbour", "distance"])

    wanted = members.select("part", "node").distinct().join(rows, "node")
    wanted = wanted.select(F.col("part").alias("_part"), F.col("node").alias("_node"), "worst", "_v")
    return members.groupBy("part").cogroup(wanted.groupBy("_part")).applyInArrow(run, LINK)


def _first_links(nodes: DataFrame, n: int, k: int, size: int) -> DataFrame:
    """Links to the ``k`` rows that follow, as their numbers are random: a part needs its own rows and the next ``k``."""

    def run(table: pa.Table) -> pa.Table:
        known = table["node"].to_numpy()
        order = np.argsort(known)
        known = known[order]
        lists = table["_v"].combine_chunks()
        vectors = _matrix(lists)
        missing = pc.is_null(lists.flatten()).to_numpy(zero_copy_only=False).reshape(vectors.shape).any(1)
        own = known[known // size == table["part"][0].as_py()]
        step, out = max(1, PAIR_CELLS // max(1, vectors.shape[1])), []
        for at in range(0, len(own) * k, step):
            pair = np.arange(at, min(at + step, len(own) * k))
            node = own[pair // k]
            neighbour = (node + pair % k + 1) % n
            i, j = (order[np.searchsorted(known, x)] for x in (node, neighbour))
            gaps = vectors[i].astype(float) - vectors[j]
            d = np.sqrt(np.cumsum(gaps * gaps, axis=1)[:, -1]) if gaps.shape[1] else np.zeros(len(pair))
            out.append(pa.table([pa.array(node), pa.array(neighbour), pa.array(d, mask=missing[i] | missing[j])], names=["node", "neighbour", "distance"]))
        return pa.concat_tables(out)

    needed = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda s: F.floor(F.pmod(F.col("node") - s, F.lit(n)) / F.lit(size)))
    copies = nodes.select(F.explode(F.array_distinct(needed)).alias("part"), "node", "_v")
    return copies.groupBy("part").applyInArrow(run, LINK)


def _part_sizes(n: int, k: int, vector_bytes: int, cores: int) -> tuple[int, int]:
    """Hosts of a part while links lead to following numbers, and later; 1 where parts would be too many to share vectors.

    A part holds its vectors and members in memory. At first it has about as many vectors as hosts, later up to
    ``2 * k + 1`` times as many, but never more than there are.
    """
    most, ids = -(-n // max(1, cores)), (2 * k + 1) * MEMBER_BYTES
    first = max(1, min(most, PART_BYTES // (vector_bytes + ids)))
    size = max(1, min(most, PART_BYTES // ((2 * k + 1) * vector_bytes + ids)))
    size = max(size, min(most, (PART_BYTES - n * vector_bytes) // ids))
    return first, size if size * 8 * (2 * k + 1) >= n else 1


def _graph(nodes: DataFrame, k: int, rounds: int) -> DataFrame:
    n = nodes.count()
    k = min(k, n - 1)
    if k < 1:
        return nodes.select("node", F.lit(None).cast("bigint").alias("neighbour"), F.lit(None).cast("double").alias("distance")).limit(0)
    packed = _packed(nodes)
    width = nodes.agg(F.max(F.size("_v"))).first()[0]
    cell = 4 if dict(packed.dtypes)["_v"] == "array<float>" else 8
    first, later = _part_sizes(n, k, width * cell, nodes.sparkSession.sparkContext.defaultParallelism)
    links = materialise(_first_links(packed, n, k, first).withColumn("fresh", F.lit(True)), "links")
    for turn in range(rounds):
        size = later if turn else first
        # Several partitions for a part, so that few tasks get two of them.
        members = _members(links, packed, k, turn, size, 8 * -(-n // size) if size > 1 else 0)
        rows = packed.select("node", "_v").join(links.groupBy("node").agg(F.max("distance").alias("worst")), "node")
        closer = _compare_parts(members, rows, k) if size > 1 else _compare(members.join(rows, "node"), k)
        closer = closer.withColumn("fresh", F.lit(True))
        known = links.withColumn("fresh", F.lit(False))
        links = materialise(_best(known.unionByName(closer), k), "links")
        if links.filter("fresh").count() <= SETTLED * n * k:
            break
    return links.drop("fresh")


def neighbour_graph(points: DataFrame, key: str, vector: str, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """``key, neighbour, distance``: about the ``k`` nearest other rows of every row, Euclidean."""
    nodes = _nodes(points, key, vector)
    names = nodes.select("node", F.col("_key").alias(key))
    links = _graph(nodes, k, rounds).join(names, "node")
    other = names.select(F.col("node").alias("neighbour"), F.col(key).alias("_other"))
    return links.join(other, "neighbour").select(key, F.col("_other").alias("neighbour"), "distance")


def _weights(links: DataFrame) -> DataFrame:
    """``node, neighbour, weight`` in both directions: closeness on the scale of each neighbourhood."""

    def scale(lists: pa.Array) -> pa.Array:
        out = []
        for distances in lists.to_pylist():
            d = np.asarray(distances, float)
            d = d - d.min()
            low, high, target = 0.0, float(d.max()) * 64 + 1e-9, np.log2(len(d) + 1)
            for _ in range(48):  # halving reaches the precision of a double
                middle = (low + high) / 2
                if np.exp(-d / max(middle, 1e-300)).sum() > target:
                    high = middle
                else:
                    low = middle
            out.append(np.exp(-d / max(high, 1e-300)).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    listed = links.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    own = listed.withColumn("weights", F.arrow_udf(scale, "array<double>")(F.transform("near", lambda x: x["distance"])))
    pairs = own.select("node", F.explode(F.arrays_zip("near.neighbour", "weights")).alias("p"))
    one_way = pairs.select("node", F.col("p.neighbour").alias("neighbour"), F.col("p.weights").alias("weight"))
    turned = one_way.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "weight")
    # a + b - a * b, where a missing direction weighs nothing
    return one_way.unionByName(turned).groupBy("node", "neighbour").agg(
        (F.sum("weight") - F.when(F.count(F.lit(1)) > 1, F.product("weight")).otherwise(0.0)).alias("weight")
    )


def _clipped(x: Column) -> Column:
    return F.greatest(F.lit(-MOST_STEP), F.least(F.lit(MOST_STEP), x))


def neighbour_layout(
    points: DataFrame, key: str, vector: str, k: int = K, epochs: int = EPOCHS, rounds: int = ROUNDS
) -> DataFrame:
    """``key, point`` of every row: two coordinates in which near rows stay near."""
    nodes = _nodes(points, key, vector)
    n = nodes.count()
    if n < 3:
        return nodes.select(F.col("_key").alias(key), F.array(F.col("node").cast("double"), F.lit(0.0)).alias("point"))
    edges = materialise(_weights(_graph(nodes, k, rounds)), "edges")
    start = pca_2d(nodes.select("node", F.col("_v").alias("embedding")), "node")
    widest = start.agg(F.max(F.greatest(F.abs(F.get("point", F.lit(0))), F.abs(F.get("point", F.lit(1)))))).first()[0] or 1.0
    place = start.select("node", *[(F.get("point", F.lit(i)) / widest * 10).alias(c) for i, c in enumerate("xy")])
    place = materialise(place, "places")
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        pushers = place.orderBy(key_hash(F.col("node"), F.lit(f"push{epoch}")), "node").limit(NEGATIVES).collect()
        others = place.select(F.col("node").alias("neighbour"), F.col("x").alias("u"), F.col("y").alias("v"))
        ends = edges.join(others, "neighbour").join(place, "node")
        dx, dy = F.col("u") - F.col("x"), F.col("v") - F.col("y")
        squared = dx * dx + dy * dy
        # The derivative of the logarithm of 1 / (1 + a d^2b), towards the neighbour.
        pull = F.when(
            squared > 0, 2 * CURVE_A * CURVE_B * F.pow(squared, CURVE_B - 1) / (1 + CURVE_A * F.pow(squared, CURVE_B))
        ).otherwise(0.0)
        pulled = ends.groupBy("node").agg(
            F.first("x").alias("x"),
            F.first("y").alias("y"),
            F.sum("weight").alias("mass"),
            *[F.sum(F.col("weight") * _clipped(pull * d)).alias(f"pull_{c}") for c, d in (("x", dx), ("y", dy))],
        )
        shared = place.sparkSession.sparkContext.broadcast(np.array([(r["x"], r["y"]) for r in pushers]).reshape(-1, 2))

        def push(xs: pa.Array, ys: pa.Array) -> pa.Array:
            own = np.column_stack([a.to_numpy(zero_copy_only=False) for a in (xs, ys)])
            out = np.empty_like(own)
            for at in range(0, len(own), 1024):
                gap = own[at : at + 1024, None] - shared.value[None]
                near = (gap * gap).sum(2)
                force = 2 * CURVE_B / ((0.001 + near) * (1 + CURVE_A * near**CURVE_B))
                out[at : at + 1024] = np.clip(force[:, :, None] * gap, -MOST_STEP, MOST_STEP).mean(1)
            return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in (0, 1)], names=["x", "y"])

        pushed = pulled.withColumn("push", F.arrow_udf(push, "struct<x: double, y: double>")(F.col("x"), F.col("y")))
        moved = [
            (F.col(c) + rate * _clipped((F.col(f"pull_{c}") + PUSH * F.col("mass") * F.col(f"push.{c}")) / F.greatest(F.col("mass"), F.lit(1.0)))).alias(c)
            for c in "xy"
        ]
        place = materialise(pushed.select("node", *moved), "places")
    return place.join(nodes.select("node", F.col("_key").alias(key)), "node").select(key, F.array("x", "y").alias("point"))
