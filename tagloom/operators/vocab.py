"""Vocabulary, encoding and decoding with reserved tag tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.tags import TAGS
from tagloom.functions.text import WHITESPACE, strip
from tagloom.operators.numbering import number_by_range
from tagloom.operators.topk import top_n
from tagloom.session import materialise

# Special ids, reserved tag tokens, truncation limits, the label mask.
SPECIALS = ("<pad>", "</s>", "<unk>")
PAD, EOS, UNK = 0, 1, 2
RESERVED = tuple(":" + tag for tag in TAGS)
INPUT_LIMIT = 100
LABEL_LIMIT = 90
LABEL_MASK = -100

# The part of a vocabulary that is looked up inside the row: the smallest ids, which are the most
# frequent tokens, up to this many entries of at most this many bytes each (32 MiB in all). Any
# other entry is joined, and only rows that hold such a token take part.
HEAD_ENTRIES = 500_000
HEAD_TOKEN_BYTES = 64


def _tokeniser(reserved: Sequence[str] = RESERVED) -> Callable[[pa.Array, int | None], pa.ListArray]:
    """A function of a text column and a limit: whitespace tokens, up to the limit; null has none.

    A reserved token is cut out wherever it occurs.
    """
    reserved = tuple(reserved)
    other_space = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in WHITESPACE if c != " ") + "]"

    def tokens(texts: pa.Array, limit: int | None = None) -> pa.ListArray:
        texts = pc.fill_null(texts, "")
        for token in reserved:
            texts = pc.replace_substring(texts, token, f" {token} ")
        # Not ``utf8_split_whitespace``: it may miss white space at the very end of a batch.
        if pc.any(pc.match_substring_regex(texts, other_space)).as_py():
            texts = pc.replace_substring_regex(texts, other_space, " ")
        parts = pc.split_pattern(texts, " ")
        found = parts.flatten()
        full = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0  # spaces side by side leave empty parts
        ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        before = np.concatenate(([0], np.cumsum(full)))
        ends = before[ends]
        if limit is not None:
            place = before[:-1] - np.repeat(ends[:-1], np.diff(parts.offsets.to_numpy()))
            full &= place < limit
            ends = np.concatenate(([0], np.cumsum(np.minimum(np.diff(ends), limit))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.filter(pa.array(full)))

    return tokens


def _token_counts(texts: DataFrame, columns: Sequence[str], reserved: Sequence[str], left_out: Sequence[str]) -> DataFrame:
    """``token, n``: counts per batch of rows, without the tokens ``left_out``; a row with a null text counts nothing."""
    tokens, without = _tokeniser(reserved), pa.array(left_out, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.concat_arrays([tokens(column).flatten() for column in batch.columns]).value_counts()
            found = found.filter(pc.invert(pc.is_in(found.field("values"), value_set=without)))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["token", "n"])

    rows = texts.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return rows.dropna("any").mapInArrow(count, "token string, n long")


def build_vocabulary(
    texts: DataFrame, columns: Sequence[str], reserved: Sequence[str] = RESERVED, max_size: int | None = None
) -> DataFrame:
    """``token, id``: specials, reserved tokens, then all others by falling count and token.

    ``max_size`` keeps that many ids, the most frequent tokens.
    """
    fixed = [*SPECIALS, *reserved]
    counts = _token_counts(texts, columns, reserved, fixed).groupBy("token").agg(F.sum("n").alias("n"))
    if max_size is not None:
        # Only the tokens that are kept are sorted and written.
        counts = top_n(counts, max(max_size - len(fixed), 0), [F.col("n").desc(), F.col("token")], ["token"])
    learned = number_by_range(counts, [F.col("n").desc(), F.col("token")], name="rank").select(
        "token", (F.col("rank") + len(fixed)).cast("int").alias("id")
    )
    given = texts.sparkSession.createDataFrame(list(zip(fixed, range(len(fixed)))), "token string, id int")
    return given.unionByName(learned)


def _head(vocab: DataFrame) -> tuple[list, bool]:
    """Entries ``(token, id)`` for the look-up inside rows, and whether they are all there are.

    Ids usually count up from 0, so the smallest are found by a filter: a limit over sorted rows
    would make every task send as many rows to the driver as are wanted in all.
    """
    is_short, is_low = F.octet_length("token") <= HEAD_TOKEN_BYTES, F.col("id") < HEAD_ENTRIES
    n, n_short, n_low = vocab.agg(
        F.count(F.lit(1)), F.count(F.when(is_short, 1)), F.count(F.when(is_short & is_low, 1))
    ).first()
    rows = vocab.select("token", "id").filter(is_short)
    if n_short > HEAD_ENTRIES:
        rows = rows.filter(is_low) if n_low <= HEAD_ENTRIES else rows.orderBy("id", "token").limit(HEAD_ENTRIES)
    entries = [(r["token"], r["id"]) for r in rows.collect()]
    entries.sort(key=lambda e: (e[1] is not None, e[1], e[0]))
    return entries, n == len(entries)


def _row_lookup(entries: dict, spark: SparkSession, kinds: tuple, names: Sequence[str], lists_of: Sequence[Callable], whole: bool):
    """A function of one column per name: a struct with the value of every item, null where it is not an entry.

    ``lists_of`` make the lists of items. Unless the entries are the ``whole`` vocabulary, the field ``open`` has the
    items without value, with the number of their column and their place in its list. Workers hold the entries as two
    Arrow columns, a fraction of the size of a dictionary.
    """
    (key_type, key_ddl), (value_type, value_ddl) = kinds
    shared = spark.sparkContext.broadcast([pa.array(entries.keys(), key_type), pa.array(entries.values(), value_type)])
    lists_of, n_names = tuple(lists_of), len(names)
    # Fields have fixed names, whatever the caller's are.
    open_type = pa.struct([("c", pa.int32()), ("pos", pa.int32()), ("key", key_type)])

    def place_in(keys: pa.Array, wanted: pa.Array) -> pa.Array:
        """Where each distinct ``wanted`` item is in ``keys``; the fewer of the two are hashed, as that costs the most."""
        if len(wanted) >= len(keys):
            return pc.index_in(wanted, value_set=keys)
        hits = pc.index_in(keys, value_set=wanted)
        at = np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False))
        place = np.full(len(wanted), -1)
        place[hits.take(pa.array(at)).to_numpy()] = at
        return pa.array(place, mask=place < 0)

    def look_up(*columns: pa.Array) -> pa.Array:
        lists = [make(column) for make, column in zip(lists_of, columns)]
        starts = [x.offsets.to_numpy() - x.offsets[0].as_py() for x in lists]
        items = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        found = shared.value[1].take(place_in(shared.value[0], items.dictionary)).take(items.indices)
        base = np.cumsum([0, *[x[-1] for x in starts]])
        values = [pa.ListArray.from_arrays(pa.array(x, pa.int32()), found.slice(at, x[-1])) for x, at in zip(starts, base)]
        if whole:
            return pa.StructArray.from_arrays(values, names=[f"c{i}" for i in range(n_names)])
        left = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        column = np.searchsorted(base, left, "right") - 1
        row, pos = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
        for i, x in enumerate(starts):
            own = column == i
            row[own] = np.searchsorted(x, left[own] - base[i], "right") - 1
            pos[own] = left[own] - base[i] - x[row[own]]
        order = np.argsort(row, kind="stable")
        parts = [pa.array(column[order], pa.int32()), pa.array(pos[order], pa.int32()), items.take(pa.array(left[order])).dictionary_decode()]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(columns[0])))))
        left_open = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(open_type)))
        return pa.StructArray.from_arrays([*values, left_open], names=[*[f"c{i}" for i in range(n_names)], "open"])

    ddl = ", ".join(f"c{i}: array<{value_ddl}>" for i in range(n_names))
    return F.arrow_udf(look_up, f"struct<{ddl}>" if whole else f"struct<{ddl}, open: array<struct<c: int, pos: int, key: {key_ddl}>>>")


def _row_filler(n_names: int, ddl: str):
    """A function of the lists and of ``array<struct<c, pos, value>>``: the lists with these values put in their places."""

    def fill(lists: pa.Array, patches: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(patches), 0).to_numpy(zero_copy_only=False)
        rows, given = np.repeat(np.arange(len(sizes)), sizes), patches.flatten()
        column, pos = (given.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        filled = []
        for i in range(n_names):
            part = lists.field(i)
            starts = part.offsets.to_numpy() - part.offsets[0].as_py()
            items, own = part.flatten(), np.flatnonzero(column == i)
            take = np.arange(len(items))
            take[starts[rows[own]] + pos[own]] = len(items) + own
            filled.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.concat_arrays([items, given.field(2)]).take(pa.array(take))))
        return pa.StructArray.from_arrays(filled, names=[f"c{i}" for i in range(n_names)])

    return F.arrow_udf(fill, f"struct<{', '.join(f'c{i}: array<{ddl}>' for i in range(n_names))}>")


def _resolve(
    rows: DataFrame, arrays: dict[str, Column], lists_of: Sequence[Callable], vocab: DataFrame, key: str, value: str, keep: Sequence[str]
) -> DataFrame:
    """The columns ``keep`` and, under each name of ``arrays``, the values of its items; null if unknown.

    Narrow when the whole vocabulary is looked up inside rows. Otherwise rows are written once with
    what was found and with their open items; the distinct open items are joined with the rest of the vocabulary,
    and rows that hold one get its value put in its place. No key of the caller is needed, so repeated
    rows stay apart.
    """
    entries, whole = _head(vocab)
    types = {"token": (pa.string(), "string"), "id": (pa.int32(), "int")}
    pairs = {t: i for t, i in entries} if key == "token" else {i: t for t, i in entries}
    look_up = _row_lookup(pairs, rows.sparkSession, (types[key], types[value]), list(arrays), lists_of, whole)
    kept = [c for c in keep if c not in arrays]
    own = "_coded"
    while any(c.startswith(own) for c in [*rows.columns, *arrays]):
        own += "_"
    row, patches = f"{own}_row", f"{own}_patches"
    found = rows.select(*[F.col(f"`{c}`") for c in kept], look_up(*arrays.values()).alias(own))

    def named_lists(df: DataFrame, struct: str) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{struct}.c{i}").alias(n) for i, n in enumerate(arrays)])

    if whole:
        return named_lists(found, own)
    found = materialise(found.withColumn(row, F.monotonically_increasing_id()), "resolved")
    open_items = found.select(row, F.explode(f"{own}.open").alias("_open")).select(
        row, "_open.c", "_open.pos", F.col("_open.key").alias("_key")
    )
    rest = vocab.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    named = materialise(open_items.select("_key").distinct().join(rest, "_key"), "named")
    # An item that is in no vocabulary may be frequent: a broadcast spares it the way to one task.
    if _fits_broadcast(named):
        named = F.broadcast(named)
    values = open_items.join(named, "_key").groupBy(row).agg(
        F.collect_list(F.struct("c", "pos", F.col("_value").alias("value"))).alias(patches)
    )
    joined = found.join(values, row, "left")
    lists = F.struct(*[F.col(f"{own}.c{i}") for i in range(len(arrays))])
    fill = _row_filler(len(arrays), types[value][1])
    return named_lists(joined.withColumn(own, fill(lists, F.col(patches))), own)


def _fits_broadcast(named: DataFrame) -> bool:
    """Whether the entries are within the bounds of the look-up inside rows."""
    text = F.octet_length(F.concat(F.col("_key").cast("string"), F.col("_value").cast("string")))
    n, size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return n <= HEAD_ENTRIES and size <= HEAD_ENTRIES * HEAD_TOKEN_BYTES


def encode_columns(
    texts: DataFrame,
    vocab: DataFrame,
    columns: dict[str, tuple[str, int | None]],
    reserved: Sequence[str] = RESERVED,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``texts`` with one id column per entry of ``columns``: its name -> text column, limit.

    Ids end with the end mark and are at most the limit in all (None: no limit). Every row stays,
    also repeated ones; a null text has the end mark only. ``keep`` names the columns of ``texts`` that are wanted.
    """
    tokens = _tokeniser(reserved)
    lists_of = [partial(tokens, limit=None if limit is None else limit - 1) for _, limit in columns.values()]
    given = {name: F.col(column).cast("string") for name, (column, _) in columns.items()}
    coded = _resolve(texts, given, lists_of, vocab, "token", "id", texts.columns if keep is None else keep)
    end = F.array(F.lit(EOS))
    return coded.withColumns(
        {n: F.concat(F.transform(n, lambda x: F.coalesce(x, F.lit(UNK))), end) for n in columns}
    )


def encode(
    texts: DataFrame,
    vocab: DataFrame,
    column: str,
    max_length: int | None,
    reserved: Sequence[str] = RESERVED,
    keys: Sequence[str] = ("row_id",),
) -> DataFrame:
    """The keys and ``ids`` of one column; see ``encode_columns``."""
    coded = encode_columns(texts.select(*keys, column), vocab, {"ids": (column, max_length)}, reserved, keep=keys)
    return coded.select(*keys, "ids")


def restore_mask(ids: Column, pad: int = PAD) -> Column:
    """Masked label positions become padding, so that they can be decoded."""
    return F.transform(ids, lambda x: F.when(x == LABEL_MASK, F.lit(pad)).otherwise(x))


def decode_columns(coded: DataFrame, vocab: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``coded`` with one text column per entry of ``columns``: its name -> id column.

    Tokens joined by spaces without special ids, stripped. Every row stays.
    """
    kept = {n: F.filter(F.col(c).cast("array<int>"), lambda x: ~x.isin(PAD, EOS, UNK)) for n, c in columns.items()}
    items = {n: F.coalesce(a, F.array().cast("array<int>")) for n, a in kept.items()}
    named = _resolve(coded, items, [lambda lists: lists] * len(items), vocab, "id", "token", coded.columns)
    return named.withColumns({n: strip(F.array_join(F.filter(n, lambda t: t.isNotNull()), " ")) for n in columns})


def decode(coded: DataFrame, vocab: DataFrame, column: str = "ids", keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """The keys and ``text`` of one id column."""
    return decode_columns(coded.select(*keys, column), vocab, {"text": column}).select(*keys, "text")
