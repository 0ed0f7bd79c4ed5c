"""Mixing sources by temperature.

A source's weight is its token share to the power ``alpha``, normalised: 1 keeps the shares, 0 makes
sources equal. ``alpha`` is found by repeated section: one job evaluates a grid of exponents over the
table of sources, the next refines the interval that holds the target. Targets: an entropy of the weights, or
the flattest weights under which no source is seen more than ``repetition`` times.

The weights are realised in whole and partial epochs. Each source is cut into ``BLOCKS`` blocks by a hash of
``doc_id``; every epoch is a permutation of the blocks. A last, partial epoch takes blocks in its own order
while they fit the budget, and of the first that does not fit the documents that do, in hash order.
Which documents appear, and how often, follows from a small table per source, so texts are not shuffled.

The budget is given in tokens; by default it is the least that shows every document of every source once,
so nothing is dropped. Tokens are the words of a text, runs of characters other than ASCII white space.

Defined results: a null or empty text has no tokens and appears in every whole epoch; documents
without a source are a source of their own; a source without tokens appears once; rows sharing a ``doc_id``
appear equally often; an empty table gives no rows; all columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.session import materialise

BLOCKS = 1024
REPETITION = 1.5
GRID, ROUNDS = 33, 4
WORD = r"[^\x20\x09-\x0D]+"


def _source(name: str = "source") -> Column:
    """Never null: the prefix sets documents without a source apart."""
    return F.coalesce(F.concat(F.lit("s:"), F.col(name)), F.lit("none"))


def _tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _block(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), doc_id), F.lit(BLOCKS)).cast("int")


def _place(doc_id: Column) -> Column:
    """A document's place in the order of its block."""
    return F.xxhash64(F.lit("place"), doc_id)


def find_alpha(
    shares: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget_share: float | None = None
) -> float:
    """The exponent for the target; ``shares`` has a column ``share`` of positive shares.

    Entropy falls and repetition falls as the exponent grows; outside their range the nearer end is taken.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / (GRID - 1)
        grid = F.array(*[F.lit(low + i * step) for i in range(GRID)])
        power = F.pow("share", "alpha")
        ratio = F.pow("share", F.col("alpha") - 1)
        rows = shares.select("share", F.explode(grid).alias("alpha")).groupBy("alpha").agg(
            F.sum(power).alias("z"), F.sum(power * F.ln("share")).alias("l"), F.max(ratio).alias("most"), F.min(ratio).alias("least")
        )
        table = sorted(rows.collect(), key=lambda r: r["alpha"])
        if not table:
            return 1.0

        def too_flat(r) -> bool:
            if entropy is not None:
                return math.log(r["z"]) - r["alpha"] * r["l"] / r["z"] > entropy
            seen = r["most"] / r["least"] if budget_share is None else r["most"] / r["z"] * budget_share
            return seen > repetition

        below = [r["alpha"] for r in table if too_flat(r)]
        low = max(below, default=low)
        high = min((r["alpha"] for r in table if r["alpha"] > low), default=high) if below else low
        if low == high:
            break
    return high


def plan(docs: DataFrame, budget: int | None = None, **target) -> tuple[DataFrame, DataFrame]:
    """Narrow rows of the documents, and per source: weight, epochs and what the partial epoch takes."""
    narrow = docs.select("doc_id", _source().alias("_source"), _tokens().alias("tokens"))
    narrow = narrow.withColumns({"block": _block(F.col("doc_id")), "place": _place(F.col("doc_id"))})
    narrow = materialise(narrow, "mix-tokens")
    # Blocks of a source bound this table; sources follow from it.
    blocks = materialise(narrow.groupBy("_source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    totals = blocks.groupBy("_source").agg(F.sum("tokens").alias("total"))
    whole = totals.agg(F.sum("total")).first()[0] or 0
    shares = materialise(totals.withColumn("share", F.col("total") / F.lit(float(max(whole, 1)))), "mix-shares")
    positive = shares.where("share > 0").select("share")
    alpha = find_alpha(positive, budget_share=budget / whole if budget and whole else None, **target)
    powers = positive.agg(F.sum(F.pow("share", F.lit(alpha))).alias("z"), F.min(F.pow("share", F.lit(alpha - 1))).alias("least")).first()
    z, least = powers["z"] or 1.0, powers["least"] or 1.0
    tokens = float(budget) if budget else whole * z / least
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    # A hair is added so that a rounding error does not take a document from a whole epoch.
    epochs = F.when(F.col("share") > 0, weight * F.lit(tokens) / F.col("total") + 1e-9).otherwise(1.0)
    sources = shares.select("_source", "total", weight.alias("weight"), epochs.alias("epochs"))
    sources = sources.withColumn("full", F.floor("epochs").cast("int"))
    sources = sources.withColumn("room", F.floor((F.col("epochs") - F.col("full")) * F.col("total")))
    order = Window.partitionBy("_source").orderBy(_turn(F.col("full") + 1), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = blocks.join(sources, "_source").withColumn("before", before)
    taken = F.col("before") + F.col("tokens") <= F.col("room")
    edge = ~taken & (F.col("before") < F.col("room"))
    partial = ranked.groupBy("_source").agg(
        F.collect_list(F.when(taken, F.col("block"))).alias("taken"),
        F.max(F.when(edge, F.col("block"))).alias("edge"),
        F.max(F.when(edge, F.col("room") - F.col("before"))).alias("rest"),
    )
    sources = materialise(sources.join(partial, "_source"), "mix-sources")
    return narrow, _with_cut(narrow, sources)


def _turn(epoch: Column) -> Column:
    """The key that orders the blocks of a source in an epoch."""
    return F.xxhash64(F.lit("turn"), F.col("_source"), epoch, F.col("block"))


def _with_cut(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``cut``: the last place that fits in the edge block (one block of each source is read)."""
    edges = sources.where("edge IS NOT NULL").select("_source", F.col("edge").alias("block"), "rest")
    inside = narrow.join(edges, ["_source", "block"])
    # Equal places are one document's rows; a range frame takes them together.
    upto = F.sum("tokens").over(Window.partitionBy("_source", "block").orderBy("place"))
    cuts = inside.withColumn("upto", upto).where("upto <= rest").groupBy("_source").agg(F.max("place").alias("cut"))
    return materialise(sources.join(cuts, "_source", "left"), "mix-plan")


def _copies() -> Column:
    """Times a document appears, from its source's row."""
    last = F.array_contains("taken", F.col("block")) | ((F.col("block") == F.col("edge")) & (F.col("place") <= F.col("cut")))
    return F.col("full") + F.coalesce(last, F.lit(False)).cast("int")


def mixture(docs: DataFrame, budget: int | None = None, **target) -> DataFrame:
    """``doc_id, source, n_tokens, weight, epoch, block, turn``: one row for each time a document appears.

    Epochs count from 1; within an epoch and source, blocks go in the order of ``turn``.
    """
    narrow, sources = plan(docs, budget, **target)
    placed = narrow.join(sources, "_source").withColumn("copies", _copies())
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))
    rows = placed.withColumn("epoch", F.explode(times))
    return rows.select(
        "doc_id",
        F.when(F.col("_source") != "none", F.substring("_source", 3, 1 << 30)).alias("source"),
        F.col("tokens").alias("n_tokens"),
        "weight",
        "epoch",
        "block",
        _turn(F.col("epoch")).alias("turn"),
    )


def mix(docs: DataFrame, budget: int | None = None, **target) -> DataFrame:
    """The documents with their own columns, each as often as the mixture shows it."""
    _, sources = plan(docs, budget, **target)
    held = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*held).alias("_doc"), _source().alias("_source"), F.col("doc_id").alias("_id"))
    rows = rows.withColumns({"block": _block(F.col("_id")), "place": _place(F.col("_id"))})
    times = rows.join(sources, "_source").withColumn("copies", _copies())
    times = times.where("copies > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return times.select("_doc.*")
