"""Near duplicates: banded MinHash candidates, odd-sketch verification, exact confirmation.

1. One pass over the texts gives each document's set of 5-word shingles (64-bit hashes), a MinHash
   signature folded into an odd sketch (a parity bitmap), and band keys. Equal sets share a set key.
2. Equal sets are collapsed by aggregation: one representative stands for any number of copies.
3. Representatives that share a band key form a bucket. First every member is compared with the
   bucket's hub, which links large groups with work in proportion to their size. Then
   members of buckets with one hub that are still in different components are compared with each
   other. Groups of more than ``SMALL`` are cut into tiles that verify inside the task and return links only,
   so no task holds a group whole and no pairs are emitted; members of a group's largest component
   only answer, so a group of copies with few others is compared in linear work.
4. A candidate pair survives if set sizes allow the similarity and the odd sketches differ in at most
   ``MOST_BITS`` bits (4.6 standard deviations above the expectation at 0.75), and is then confirmed on
   full sets.
5. Components are found by star contraction over links, all in tables; copies follow their representative
   afterwards, so that large groups of copies put no edges on one vertex.

A pair of similarity 0.75 shares none of the 32 bands of 4 with a chance of 5e-6.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing;
rows sharing a ``doc_id`` are one document and stay or go together; a row with a null ``doc_id`` is
compared with nothing, has no component and is kept; an empty table gives no rows; extra columns do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import ship
from tagloom.session import materialise

SHINGLE = 5
BANDS, ROWS = 32, 4
SKETCH_WORDS = 4  # of 64 bits
MOST_BITS = 84
SMALL = 32  # members of a group whose pairs are joined
TILE = 500
SMALL_IDS = 200_000  # ids below this count (8 bytes each) may be broadcast
MEMO = 120_000  # words remembered by a worker

SAMPLES = BANDS * ROWS
BITS = 64 * SKETCH_WORDS
SIGNED = ", ".join(f"s{i} bigint" for i in range(SKETCH_WORDS))
SIGNATURE = f"doc_id bigint, n_shingles bigint, set_key binary, {SIGNED}, bands array<bigint>"


@cache
def _word_codes() -> dict[bytes, int]:
    return {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (unsigned 64-bit, wrapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of 5-word shingles; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = _word_codes()
    codes = list(map(known.get, words))
    if None in codes:
        if len(known) >= MEMO:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        codes = list(map(known.__getitem__, words))
    codes = np.asarray(codes, np.uint64)
    width = min(SHINGLE, len(codes))
    n = len(codes) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return np.unique(total)


@cache
def _sample_keys() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64)
    mixed = _mix(seeds * np.uint64(0x9E3779B97F4A7C15))
    return mixed[:SAMPLES] | np.uint64(1), mixed[SAMPLES:]


def signature(items: np.ndarray) -> np.ndarray:
    """MinHash values of a set, in blocks that keep long texts in bounded memory."""
    factor, offset = _sample_keys()
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 512):
        # The high bits of an odd multiple are well mixed; offsets make the orders differ.
        np.minimum(least, (items[i : i + 512, None] * factor + offset).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of how many ``(position, value)`` samples fall on each bit, as signed words."""
    at = _mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    parity = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return total.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set key, odd sketch and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches, bands = [], [], [], []
            for text in batch["text"].cast(pa.large_binary()):
                items = shingles(text.as_py() or b"")
                sizes.append(len(items))
                keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                samples = signature(items)
                sketches.append(odd_sketch(samples))
                bands.append(band_keys(samples) if len(items) else np.empty(0, np.int64))
            words = np.asarray(sketches, np.int64).reshape(-1, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    *(pa.array(words[:, i]) for i in range(SKETCH_WORDS)),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=[f.split()[0] for f in SIGNATURE.split(", ")],
            )

    ship(docs.sparkSession)
    return _narrow(docs).mapInArrow(run, SIGNATURE)


def full_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, items``: the shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                sets = [shingles(t.as_py() or b"").view(np.int64) for t in part["text"].cast(pa.large_binary())]
                columns = [part["doc_id"], pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "items"])

    return _narrow(docs).mapInArrow(run, "doc_id bigint, items array<bigint>")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _only(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows whose ``doc_id`` is among ``n`` distinct ids; a few ids are broadcast, many are joined."""
    ids = ids.withColumnRenamed("doc_id", "_id")
    return rows.join(F.broadcast(ids) if n <= SMALL_IDS else ids, F.col("doc_id").cast("long") == F.col("_id"), "left_semi")


def _alike(a: str, b: str) -> Column:
    """Set sizes and odd sketches allow the similarity."""
    bits = F.lit(0)
    for i in range(SKETCH_WORDS):
        bits = bits + F.bit_count(F.col(f"{a}_s{i}").bitwiseXOR(F.col(f"{b}_s{i}")))
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    return (100 * F.least(n, m) >= 75 * F.greatest(n, m)) & (bits <= MOST_BITS)


def _sketch(rows: DataFrame, side: str) -> DataFrame:
    words = [F.col(f"s{i}").alias(f"{side}_s{i}") for i in range(SKETCH_WORDS)]
    return rows.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"{side}_n"), *words)


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity; every text is read once."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = materialise(ids, "dedup-ids")
    sets = materialise(full_sets(_only(docs, ids, ids.count())), "dedup-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(100 * both >= 75 * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``doc_id, component_id`` of every linked document, by large and small star contraction.

    Each round hangs neighbours on smaller ids; it ends when no edge changes. Every round is written
    to the shared folder, so plans stay short and lost executors cost one round at most.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, before = materialise(edges, "dedup-edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct(), "dedup-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "dedup-edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
        before = state


def _with_component(rows: DataFrame, found: DataFrame, key: str, out: str) -> DataFrame:
    found = found.select(F.col("doc_id").alias(key), F.col("component_id").alias("_c"))
    return rows.join(found, key, "left").withColumn(out, F.coalesce("_c", key)).drop("_c")


def _bucket_members(reps: DataFrame) -> DataFrame:
    """``band, doc_id, hub``: members of buckets of two or more, with the bucket's hub.

    The hub is the member that meets most others over all its buckets (the smallest id of equals): in a
    group of edited copies that is the text the others derive from, if it is there.
    """
    members = reps.select(F.explode("bands").alias("band"), "doc_id")
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(members.join(sizes, "band"), "dedup-buckets")
    met = members.groupBy("doc_id").agg(F.sum("n").alias("met"))
    ranked = members.join(met, "doc_id").groupBy("band").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("id"))).alias("top"))
    return members.select("band", "doc_id").join(ranked.select("band", (-F.col("top.id")).alias("hub")), "band")


def _star_candidates(members: DataFrame, reps: DataFrame) -> DataFrame:
    pairs = members.where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    compared = pairs.join(_sketch(reps, "b"), "b").join(_sketch(reps, "a"), "a")
    return compared.where(_alike("a", "b")).select("a", "b")


def _open_groups(members: DataFrame, found: DataFrame) -> DataFrame:
    """``hub, doc_id, component_id, n``: groups of two or more components, and their sizes.

    Documents that share a bucket share its hub, so groups by hub hold every pair of every bucket, and
    a document is in few of them where it is in many buckets.
    """
    rows = members.select("hub", "doc_id").distinct()
    placed = materialise(_with_component(rows, found, "doc_id", "component_id"), "dedup-placed")
    sizes = placed.groupBy("hub").agg(
        F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.count(F.lit(1)).alias("n")
    )
    return placed.join(sizes.where("low < high").select("hub", "n"), "hub")


def _cross_candidates(groups: DataFrame, reps: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of small groups in different components, not compared before: at most ``SMALL`` a row."""
    sketched = groups.join(reps.select("doc_id", "n_shingles", *(f"s{i}" for i in range(SKETCH_WORDS))), "doc_id")

    def side(name: str) -> DataFrame:
        words = [F.col(f"s{i}").alias(f"{name}_s{i}") for i in range(SKETCH_WORDS)]
        kept = [F.col("doc_id").alias(name), F.col("component_id").alias(f"{name}_c"), F.col("n_shingles").alias(f"{name}_n")]
        return sketched.select("hub", *kept, *words)

    met = side("a").join(side("b"), "hub")
    met = met.where((F.col("a") < F.col("b")) & (F.col("a_c") != F.col("b_c")) & _alike("a", "b"))
    return met.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")


def _tile_links(tile: pa.Table) -> pa.Table:
    """Links between the outsiders and the members of one tile; pairs already joined are passed over.

    Sizes and odd sketches of all pairs are compared in arrays, full sets only of what is left.
    """
    ids, asks, outside, parts = (tile[c].to_pylist() for c in ("doc_id", "asks", "outside", "component_id"))
    sets = [np.asarray(x.values.to_numpy()) for x in tile["items"].combine_chunks()]
    sizes = np.asarray([len(x) for x in sets])
    words = np.stack([tile[f"s{i}"].to_numpy() for i in range(SKETCH_WORDS)], axis=1).view(np.uint64)
    parent = {c: c for c in parts}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    second = np.flatnonzero(~np.asarray(asks, bool))
    numbers, outsiders = np.asarray(ids)[second], np.asarray(outside, bool)[second]
    for i in np.flatnonzero(asks).tolist():
        others = second[~outsiders | (numbers > ids[i])]  # two outsiders are compared once
        bits = np.bitwise_count(words[others] ^ words[i]).sum(axis=1)
        lesser, greater = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        for j in others[(bits <= MOST_BITS) & (100 * lesser >= 75 * greater)].tolist():
            x, y = root(parts[i]), root(parts[j])
            if x == y:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 75 * (sizes[i] + sizes[j] - both):
                parent[max(x, y)] = min(x, y)
                links.append((ids[i], ids[j]))
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _tiles(groups: DataFrame) -> DataFrame:
    """``hub, ask, answer, asks, outside, doc_id, component_id``: members of tiles, ``2 * TILE`` about.

    Members of the largest component of a group are one component already, so only the others, the
    outsiders, ask. They form blocks of about ``TILE``, and so do all members, which answer; a tile is a pair of blocks.
    A group of ``n`` members with ``o`` outsiders sends about ``n * ceil(o / TILE) + o * ceil(n / TILE)`` rows.
    """
    parts = groups.groupBy("hub", "component_id").agg(F.count(F.lit(1)).alias("m"))
    largest = F.max(F.struct("m", "component_id"))
    main = parts.groupBy("hub").agg(largest.alias("top"), F.sum("m").alias("all"))
    blocks = lambda n: F.greatest(F.ceil(n / TILE), F.lit(1)).cast("int")
    main = main.select(
        "hub", F.col("top.component_id").alias("main"), blocks(F.col("all")).alias("answers"), blocks(F.col("all") - F.col("top.m")).alias("asked")
    )
    rows = groups.join(main, "hub").withColumn("outside", F.col("component_id") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["hub", "doc_id", "component_id", "outside"]
    asking = rows.where("outside").select(*kept, F.lit(True).alias("asks"), own("asked").alias("ask"), every("answers").alias("answer"))
    answering = rows.select(*kept, F.lit(False).alias("asks"), own("answers").alias("answer"), every("asked").alias("ask"))
    return asking.unionByName(answering)


def _large_group_links(docs: DataFrame, groups: DataFrame, reps: DataFrame) -> DataFrame:
    """Links that join components of large groups, compared in tiles; a tile returns fewer links than it has rows."""
    ids = materialise(groups.select("doc_id").distinct(), "dedup-ids")
    # A doc_id with several texts has several sets; each meets each of its sketches.
    sets = materialise(full_sets(_only(docs, ids, ids.count())).dropDuplicates(["doc_id", "items"]), "dedup-sets")
    sketched = _tiles(groups).join(reps.select("doc_id", *(f"s{i}" for i in range(SKETCH_WORDS))), "doc_id").join(sets, "doc_id")
    return sketched.groupBy("hub", "ask", "answer").applyInArrow(_tile_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row."""
    docs = _narrow(docs)  # columns of the caller meet no names of this module
    signed = materialise(signatures(docs), "dedup-signatures")
    keyed = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    twins = keyed.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    twins = materialise(twins, "dedup-twins")
    reps = keyed.join(twins.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    reps = materialise(reps.dropDuplicates(["doc_id", "set_key"]).drop("set_key"), "dedup-reps")
    members = materialise(_bucket_members(reps), "dedup-members")
    stars = materialise(_star_candidates(members, reps), "dedup-stars")
    links = materialise(_confirmed(docs, stars), "dedup-links")
    found = components(links)
    groups = materialise(_open_groups(members, found), "dedup-groups")
    more = materialise(_cross_candidates(groups.where(F.col("n") <= SMALL), reps, stars), "dedup-cross")
    large = materialise(_large_group_links(docs, groups.where(F.col("n") > SMALL), reps), "dedup-large-links")
    # Equal sets follow their representative; only a doc_id with several texts ties such groups together.
    texts = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("set_key").alias("low"), F.max("set_key").alias("high"), F.count("set_key").alias("sets"), F.count(F.lit(1)).alias("rows")
    )
    several = materialise(texts.where("low < high OR (sets > 0 AND sets < rows)").select("doc_id"), "dedup-several")
    ties = keyed.select("doc_id", "set_key").distinct().join(several, "doc_id", "left_semi").join(twins, "set_key")
    links = links.unionByName(_confirmed(docs, more)).unionByName(large)
    found = components(links.unionByName(ties.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    placed = _with_component(twins, found, "rep", "by_set").select("set_key", "by_set")
    tied = found.join(several, "doc_id", "left_semi").withColumnRenamed("component_id", "by_doc")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("by_doc", "by_set", "doc_id"))
    return signed.join(placed, "set_key", "left").join(tied, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stand for their groups, with their own columns."""
    name = "_dropped"
    while name in docs.columns:
        name += "_"
    dropped = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    dropped = materialise(dropped, "dedup-dropped")
    if dropped.count() <= SMALL_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(name), "left_anti")
