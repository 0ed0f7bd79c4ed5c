"""Quality rules from tokeniser fertility.

Every text is encoded by two public vocabularies (byte-level pairs, and pieces with byte fallback).
Per document that gives characters per token for each, the share of byte-fallback pieces, and the
entropy of the piece distribution relative to that of equally many different pieces. Bands of
acceptance are set per language (per script where the language is missing), as robust quantile
bands over all documents that pass the base rules: median plus or minus ``WIDTH`` robust deviations.

No number of documents switches bands. A language's median leans on that of its main script, and a
script's on that of all documents, less and less as documents are more: by ``v / (v + distance^2)``, where
``v`` is ``PRIOR`` squared deviations of the wider group over the number of documents. The language's squared
deviation grows by the same ``v``. So its own median is always well inside its band, however few
documents it has and however far other languages are, and large languages keep to their own values.

Base rules: fewer than 50 words fail, or more than half of the words in repeated 3-word windows.

Defined results: a null or empty text has no words and fails the base rules; measures without tokens
are null and reject nothing; repeated rows are judged alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import ship
from tagloom.session import materialise

PAIRS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
WIDTH = 3.6
SHORT = 150.0  # words at which the band is wider by the root of two; short texts vary more
PRIOR = 20.0  # documents that the wider group counts for in the band of a language
LEAST_DEVIATION = 0.02  # of the median; a tight corpus must not reject its own ordinary spread
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
# The pair encoder's pattern keeps a state per character of white space and ends with an error near 1,000,000 of them:
# texts beyond this length are cut at long runs.
LONG_TEXT, LONG_RUN = 400_000, 100_000
RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
MEASURES = ("chars_per_pair_token", "chars_per_piece", "byte_share", "entropy")
COUNTS = ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", "n_pair_tokens", "n_pieces", "n_bytes_pieces")
SCHEMA = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in COUNTS), "piece_entropy double"])


class Coder:
    """Both encodings of whole texts."""

    def __init__(self, pairs_path: str, pieces_path: str):
        with open(pairs_path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.pairs = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.is_byte = np.asarray([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])

    def codes(self, text: str) -> tuple[int, np.ndarray]:
        """Number of pair tokens, and the ids of all pieces; a line end counts as a space."""
        text = text.replace("\n", " ")
        return self.n_pairs(text), np.asarray(self.pieces.encode(text), np.int64)

    def n_pairs(self, text: str) -> int:
        """A run of white space is one match of the pattern, but for its last character if more text follows."""
        n, start = 0, 0
        for run in RUNS.finditer(text) if len(text) > LONG_TEXT else ():
            end = run.end() - (run.end() < len(text))
            n += len(self.pairs.encode_to_numpy(text[start : run.start()], disallowed_special=()))
            n += len(self.pairs._encode_single_piece(text[run.start() : end]))
            start = end
        return n + len(self.pairs.encode_to_numpy(text[start:], disallowed_special=()))


@cache
def coder(pairs_path: str, pieces_path: str) -> Coder:
    return Coder(pairs_path, pieces_path)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(windows) + k] |= again
    return int(inside.sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return len(lines) - len(set(lines))


def entropy_of(ids: np.ndarray) -> float | None:
    """0 for one repeated piece, 1 when all pieces differ."""
    if len(ids) < 2:
        return None
    times = np.unique(ids, return_counts=True)[1]
    return float(1 - (times * np.log(times)).sum() / (len(ids) * np.log(len(ids))))


def measure(docs: DataFrame) -> DataFrame:
    """Word counts and token counts of every document."""
    paths = [public_tokenizers.path(PAIRS), public_tokenizers.path(PIECES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(*paths)
        for batch in batches:
            rows = []
            for value in batch["text"]:
                text = value.as_py() or ""
                raw = text.encode()
                words = raw.split()
                pair_tokens, ids = own.codes(text)
                chars = len(text) - sum(map(text.count, WHITE))
                counts = (len(words), chars, repeated_lines(raw), repeated_words(words), pair_tokens, len(ids))
                rows.append((*counts, int(own.is_byte[ids].sum()), entropy_of(ids)))
            columns = list(zip(*rows)) or [[]] * (len(COUNTS) + 1)
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()]
            arrays = [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds)), *extra(batch)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", *COUNTS, "piece_entropy", "n_symbols", "script", "lang"]

    def extra(batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch["n_symbols"], batch["script"], batch["lang"]]

    ship(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        _script().alias("script"),
        (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"),
    )
    found = rows.mapInArrow(run, f"{SCHEMA}, n_symbols bigint, script string, lang string")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return found.withColumns(
        {
            "chars_per_pair_token": ratio("word_chars", "n_pair_tokens"),
            "chars_per_piece": ratio("word_chars", "n_pieces"),
            "byte_share": ratio("n_bytes_pieces", "n_pieces"),
            "entropy": F.col("piece_entropy"),
            "group_name": F.coalesce("lang", "script"),
        }
    )


def _script() -> Column:
    """The script of the first letter."""
    letter = F.regexp_extract(F.coalesce("text", F.lit("")), r"\p{L}", 0)
    script = F.lit("other")
    for name in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hangul", "Hiragana", "Katakana"):
        script = F.when(letter.rlike(rf"\p{{Is{name}}}"), name).otherwise(script)
    return script


def bands(measured: DataFrame) -> DataFrame:
    """``band_name, <measure>_mid, <measure>_dev`` of each language, or script where that is missing."""
    passed = measured.where(~base_failed())
    # The script that most of a group's documents begin in; documents keep to their group's script.
    scripts = passed.groupBy("group_name").agg(F.mode("script", deterministic=True).alias("main_script"))
    scripts = materialise(scripts, "fertility-scripts")

    def spread(m: str) -> list[Column]:
        low, mid, high = (F.col(f"q_{m}")[i] for i in range(3))
        # Half the middle half is 0.6745 standard deviations of a normal spread.
        deviation = F.greatest((high - low) / 2 / 0.6745, F.abs(mid) * LEAST_DEVIATION, F.lit(LEAST_DEVIATION / 4))
        return [F.col(f"n_{m}"), mid.alias(f"{m}_mid"), F.when(mid.isNotNull(), deviation).alias(f"{m}_dev")]

    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(f"q_{m}") for m in MEASURES]
    counts = [F.count(m).alias(f"n_{m}") for m in MEASURES]
    grouped = passed.join(scripts, "group_name").rollup("main_script", "group_name").agg(
        F.grouping_id().alias("level"), *quartiles, *counts
    )
    levels = materialise(grouped.select("level", "main_script", "group_name", *[c for m in MEASURES for c in spread(m)]), "fertility-levels")
    own, script, whole = (levels.where(F.col("level") == k) for k in (0, 1, 3))
    script = _leaning(script, whole.drop("main_script"), F.lit(True), widen=False)
    own = _leaning(own, script.select("main_script", *_limits()), "main_script", widen=True)
    return own.select(F.col("group_name").alias("band_name"), *_limits())


def _limits() -> list[str]:
    return [f"{m}_{part}" for m in MEASURES for part in ("mid", "dev")]


def _leaning(rows: DataFrame, wider: DataFrame, on: Column | str, widen: bool) -> DataFrame:
    """Bands of ``rows`` that lean on those of their ``wider`` groups the more, the fewer documents they have."""
    wider = wider.select(*([on] if isinstance(on, str) else []), *[F.col(c).alias(f"wide_{c}") for c in _limits()])
    changed = {}
    for m in MEASURES:
        n, mid, dev = F.col(f"n_{m}"), F.col(f"{m}_mid"), F.col(f"{m}_dev")
        wide_mid, wide_dev = F.col(f"wide_{m}_mid"), F.col(f"wide_{m}_dev")
        v = PRIOR * wide_dev * wide_dev / n
        lean = v / (v + (mid - wide_mid) * (mid - wide_mid))
        squared = dev * dev + v
        changed[f"{m}_mid"] = F.when(n > 0, mid + lean * (wide_mid - mid)).otherwise(wide_mid)
        # Without widening it is the mean of the squares by number of documents.
        changed[f"{m}_dev"] = F.when(n > 0, F.sqrt(squared if widen else squared * n / (n + PRIOR))).otherwise(wide_dev)
    return rows.join(F.broadcast(wider), on).withColumns(changed)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fertility_rules(docs: DataFrame) -> DataFrame:
    """Counts, measures and verdict for each document."""
    measured = materialise(measure(docs), "fertility")
    limits = materialise(bands(measured), "fertility-bands")
    judged = measured.join(limits, F.col("group_name") == F.col("band_name"), "left")
    outside = F.lit(False)
    for m in MEASURES:
        mid, dev = F.col(f"{m}_mid"), F.col(f"{m}_dev")
        # A text without words fails the base rules; its width only has to be defined.
        allowed = WIDTH * dev * F.sqrt(1 + F.lit(SHORT) / F.greatest("n_words", F.lit(1)))
        outside = outside | F.coalesce(F.abs(F.col(m) - mid) > allowed, F.lit(False))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~outside).alias("kept"),
        *MEASURES,
    )
