"""Entity matching of long rows through an index of the row's own tokens.

The expressions in ``segments`` compare every prediction with every gold entity, token by token. That
is the fastest form for the usual handful of entities; here the entities that hold a token are looked up
instead, so a row with thousands of entities on both sides takes seconds. The results are the same.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.segments import MISSING_TOKENS_ALLOWED

Entity = tuple[list[str], str]

# Rows with at most this many pairs of entities stay in the JVM.
SHORT_ROW_PAIRS = 400


class TokenIndex:
    """Which entities of a list hold a token, and which of them are still free."""

    def __init__(self, entities: list[Entity]):
        holders: dict[str, list[int]] = {}
        for i, (tokens, _) in enumerate(entities):
            for token in set(tokens):
                holders.setdefault(token, []).append(i)
        self.holders = {t: np.array(ids) for t, ids in holders.items()}
        self.free = np.ones(len(entities), bool)
        self.passed = dict.fromkeys(holders, 0)  # holders of a token that are known to be taken

    def first(self, tokens: list[str]) -> int | None:
        """The first free entity that holds all but ``MISSING_TOKENS_ALLOWED`` of the tokens, and one at least."""
        needed = max(1, len(tokens) - MISSING_TOKENS_ALLOWED)
        own = {t: n for t, n in Counter(tokens).items() if t in self.holders}
        if not own:
            return None
        if needed == 1:
            firsts = [at for t in own if (at := self._first_holder(t)) is not None]
            return min(firsts, default=None)
        shared = np.zeros(len(self.free), np.int64)
        for token, n in own.items():
            shared[self.holders[token]] += n
        good = (shared >= needed) & self.free
        at = int(good.argmax())
        return at if good[at] else None

    def _first_holder(self, token: str) -> int | None:
        ids, k = self.holders[token], self.passed[token]
        while k < len(ids) and not self.free[ids[k]]:
            k += 1
        self.passed[token] = k
        return int(ids[k]) if k < len(ids) else None


def match_row(pred: list[Entity], gold: list[Entity]) -> tuple[int, int]:
    """True positives of the greedy matching, and the gold entities whose first match has their tag."""
    index, hits = TokenIndex(gold), 0
    for tokens, tag in pred:
        at = index.first(tokens)
        if at is not None:
            index.free[at] = False
            hits += gold[at][1] == tag
    index, found = TokenIndex(pred), 0
    for tokens, tag in gold:
        at = index.first(tokens)
        found += at is not None and pred[at][1] == tag
    return hits, found


def is_long(pred: Column, gold: Column) -> Column:
    return F.size(pred).cast("bigint") * F.size(gold) > SHORT_ROW_PAIRS


def match_counts(pred: Column, gold: Column) -> Column:
    """``struct<tp, recalled>`` of long rows, NULL for all others, which send no entities to Python."""

    def run(preds: pa.Array, golds: pa.Array) -> pa.Array:
        found = []
        for p, g in zip(preds, golds):
            sides = [[(e["tokens"], e["tag"]) for e in x.as_py()] for x in (p, g) if x.is_valid]
            found.append(dict(zip(("tp", "recalled"), match_row(*sides))) if len(sides) == 2 else None)
        return pa.array(found, pa.struct([("tp", pa.int64()), ("recalled", pa.int64())]))

    both = [F.when(is_long(pred, gold), x) for x in (pred, gold)]
    return F.arrow_udf(run, "struct<tp: bigint, recalled: bigint>")(*both)
