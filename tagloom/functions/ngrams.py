"""N-gram statistics for corpus BLEU.

The counts of one row need nothing but that row, so they stay inside it: no exploded n-grams, no
shuffle. They come from an Arrow-batched function: on the larger test scale it took half to a
quarter of the time of nested array functions, and less than half of exploding the n-grams.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ORDER = 4
ORDERS = range(1, MAX_ORDER + 1)
BLEU_COLUMNS = (
    *[f"matches_{n}" for n in ORDERS],
    *[f"totals_{n}" for n in ORDERS],
    "pred_len",
    "label_len",
)

# The public "13a" tokenisation of machine-translation scoring. Literal
# replacements come first, then the patterns, in this order.
LITERALS_13A = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
PATTERNS_13A = (
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)


def tokens_13a(text: str) -> list[str]:
    for old, new in LITERALS_13A:
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, replacement in PATTERNS_13A:
        text = pattern.sub(replacement, text)
    return text.split()


def ngram_counts(tokens: list[str], order: int) -> Counter:
    return Counter(zip(*[tokens[start:] for start in range(order)]))


def pair_counts(pred: str, label: str) -> list[int]:
    """Values of ``BLEU_COLUMNS`` for one pair."""
    ours, gold = tokens_13a(pred), tokens_13a(label)
    matches = []
    for order in ORDERS:
        in_gold = ngram_counts(gold, order)
        found = ngram_counts(ours, order)
        matches.append(sum(min(n, in_gold[gram]) for gram, n in found.items() if gram in in_gold))
    totals = [max(len(ours) - order + 1, 0) for order in ORDERS]
    return [*matches, *totals, len(ours), len(gold)]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in BLEU_COLUMNS]))
def bleu_counts(pred: pd.Series, label: pd.Series) -> pd.DataFrame:
    rows = [pair_counts(p, g) for p, g in zip(pred, label)]
    return pd.DataFrame(rows, columns=list(BLEU_COLUMNS), dtype="int64")
