"""Row-local entity scoring of a predicted label string against the gold one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.arrays import let, positions

# Fixed value: what counts as a tag inside a label string.
SEGMENT_TAG_REGEX = ":[A-Za-z]+"

# Fixed value: a name may miss this many of its tokens and still match.
MISSING_TOKENS_ALLOWED = 2


def segments(text: Column) -> Column:
    """``"a b:PS c:LC"`` to ``[(["a","b"], ":PS"), (["c"], ":LC")]``.

    One character after each tag is skipped, empty tokens are kept, text after the last tag is
    ignored. Splitting on the tags keeps the scan linear in the text.
    """
    tags = F.regexp_extract_all(text, F.lit(SEGMENT_TAG_REGEX), F.lit(0))
    gaps = F.split(text, SEGMENT_TAG_REGEX)

    def pair(gap_and_tags: Column) -> Column:
        return F.transform(
            gap_and_tags["tags"],
            lambda tag, i: F.struct(
                F.split(
                    F.when(i > 0, F.substring(F.get(gap_and_tags["gaps"], i), 2, 2**31 - 1)).otherwise(
                        F.get(gap_and_tags["gaps"], i)
                    ),
                    " ",
                ).alias("tokens"),
                tag.alias("tag"),
            ),
        )

    return let(F.struct(tags.alias("tags"), gaps.alias("gaps")), pair)


def _matches(one: Column, other: Column) -> Column:
    """Enough tokens of ``one`` occur in ``other``; the threshold follows the size of ``one``."""
    shared = F.size(F.filter(one["tokens"], lambda t: F.array_contains(other["tokens"], t)))
    return (shared > 0) & (shared >= F.size(one["tokens"]) - MISSING_TOKENS_ALLOWED)


def true_positives(pred: Column, gold: Column) -> Column:
    """Greedy one-to-one matching in prediction order.

    Each prediction takes the first unused gold entity that matches by tokens. The gold entity is
    used up even when the tags differ; only equal tags count.
    """

    def step(state: Column, one: Column) -> Column:
        free = F.filter(
            positions(F.size(gold)),
            lambda i: ~F.array_contains(state["used"], i) & _matches(one, F.get(gold, i)),
        )
        return let(
            F.get(free, F.lit(0)),
            lambda hit: F.struct(
                F.when(hit.isNull(), state["used"])
                .otherwise(F.concat(state["used"], F.array(hit)))
                .alias("used"),
                (
                    state["hits"]
                    + F.when(F.get(gold, hit)["tag"] == one["tag"], 1).otherwise(0)
                ).alias("hits"),
            ),
        )

    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("hits"))
    return F.aggregate(pred, start, step, lambda state: state["hits"])


def recalled(pred: Column, gold: Column) -> Column:
    """Gold entities whose first token match among the predictions carries the same tag."""

    def found(one: Column) -> Column:
        first = F.get(F.filter(pred, lambda p: _matches(one, p)), F.lit(0))
        return F.coalesce(first["tag"] == one["tag"], F.lit(False))

    return F.size(F.filter(gold, found))


def f1_score(tp: Column, n_pred: Column, recalled_count: Column, n_gold: Column) -> Column:
    """Harmonic mean; 0 when either list is empty or either ratio is 0."""
    inverse_precision = F.lit(1.0) / F.nullif(F.try_divide(tp, n_pred), F.lit(0.0))
    inverse_recall = F.lit(1.0) / F.nullif(F.try_divide(recalled_count, n_gold), F.lit(0.0))
    return F.coalesce(F.lit(2.0) / (inverse_precision + inverse_recall), F.lit(0.0))


def accuracy(tp: Column, recalled_count: Column, n_gold: Column) -> Column:
    """Recall, zeroed with f1 when nothing was predicted correctly."""
    return F.when((tp > 0) & (n_gold > 0), recalled_count / F.nullif(n_gold, F.lit(0))).otherwise(
        F.lit(0.0)
    )
