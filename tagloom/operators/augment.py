"""Entity-swap augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.hashing import draw
from tagloom.functions.text import with_prefix
from tagloom.operators.dictionary import entities, entity_dictionary
from tagloom.operators.split import SEED
from tagloom.session import materialise

# A dictionary up to this many bytes travels inside the plan; a larger one is joined.
INLINE_BYTES = 1 << 20

# A tag gets a join key for so many uses of it, up to ``MIN_SLOTS`` of them, however few names it has.
USES_PER_SLOT = 1000
MIN_SLOTS = 1024

# The table of dictionary sizes has one row per tag; up to this many it is broadcast.
BROADCAST_TAGS = 10_000


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first literal occurrence; an empty ``old`` inserts in front."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, new, at, F.char_length(old))).otherwise(text)


def _swapped(sentence: Column, picks: Column) -> Column:
    return F.aggregate(picks, sentence, lambda text, p: replace_first(text, p["name"], p["new"]))


def _relabelled(picks: Column, label_prefix: str) -> Column:
    """New labels: the drawn name, then the old label from its first colon on."""
    rest = F.transform(
        picks, lambda p: F.concat(p["new"], F.substring(p["raw"], F.char_length(p["name"]) + 1, F.char_length(p["raw"])))
    )
    joined = F.array_join(rest, " ")
    return with_prefix(joined, label_prefix) if label_prefix else joined


def _with_rounds(prepared: DataFrame, rounds: int) -> DataFrame:
    return prepared.select(
        "row_id", "input_sentence", "labels", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")
    )


def _finish(picked: DataFrame, label_prefix: str) -> DataFrame:
    return picked.select(
        "row_id",
        "round",
        _swapped(F.col("input_sentence"), F.col("picks")).alias("input_sentence"),
        _relabelled(F.col("picks"), label_prefix).alias("train_label"),
    )


def swap_inline(
    prepared: DataFrame, dictionary_json: str, rounds: int, seed: int, label_prefix: str
) -> DataFrame:
    """Narrow form: the dictionary is a constant of the plan and nothing is shuffled."""
    names_by_tag = F.from_json(F.lit(dictionary_json), "map<string,array<string>>")

    def pick(label: Column, pos: Column) -> Column:
        names = F.element_at(names_by_tag, label["tag"])
        number = draw(F.col("row_id"), F.col("round"), pos, F.lit(seed))
        drawn = F.get(names, F.pmod(number, F.size(names)).cast("int"))
        return F.struct(
            label["raw"].alias("raw"),
            label["name"].alias("name"),
            F.coalesce(drawn, label["name"]).alias("new"),
        )

    picked = _with_rounds(prepared, rounds).withColumn("picks", F.transform("labels", pick))
    return _finish(picked, label_prefix)


def swap_joined(
    prepared: DataFrame, dictionary: DataFrame, rounds: int, seed: int, label_prefix: str
) -> DataFrame:
    """Join form for dictionaries of any size.

    Entities meet the dictionary on (tag, slot). A frequent tag with few names gets its names repeated,
    so that no join key runs hot; a rare tag does not.
    """
    uses = entities(prepared, "row_id").groupBy("tag").agg((F.count(F.lit(1)) * rounds).alias("uses"))
    sizes = dictionary.groupBy("tag").agg(F.count(F.lit(1)).alias("n_names")).join(uses, "tag", "left")
    wanted = F.least(F.lit(MIN_SLOTS), F.ceil(F.coalesce("uses", F.lit(0)) / USES_PER_SLOT))
    repeats = F.greatest(F.lit(1), F.ceil(wanted / F.col("n_names"))).cast("bigint")
    sized = sizes.select("tag", "n_names", repeats.alias("repeats"))
    slots = dictionary.join(sized, "tag").select(
        "tag",
        F.col("name").alias("new"),
        F.explode(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.col("repeats") - 1),
                lambda r: r * F.col("n_names") + F.col("idx"),
            )
        ).alias("slot"),
    )
    if dictionary.select("tag").distinct().count() <= BROADCAST_TAGS:
        sized = F.broadcast(sized)
    rows = _with_rounds(prepared, rounds)
    number = draw(F.col("row_id"), F.col("round"), F.col("pos"), F.lit(seed))
    spread = F.xxhash64("row_id", "round", "pos")
    slot = F.pmod(spread, F.col("repeats")) * F.col("n_names") + F.pmod(number, F.col("n_names"))
    # Entities of a tag that the dictionary lacks match nothing; negative slots spread them too.
    drawn = (
        entities(rows, "row_id", "round")
        .join(sized, "tag", "left")
        .withColumn("slot", F.coalesce(slot, -1 - F.pmod(spread, F.lit(MIN_SLOTS))))
        .join(slots, ["tag", "slot"], "left")
        .withColumn("new", F.coalesce("new", "name"))
        .groupBy("row_id", "round")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "raw", "name", "new"))).alias("picks"))
    )
    empty = F.array().cast("array<struct<pos:int,raw:string,name:string,new:string>>")
    picked = rows.drop("labels").join(drawn, ["row_id", "round"], "left")
    return _finish(picked.withColumn("picks", F.coalesce("picks", empty)), label_prefix)


def swap_entities(
    prepared: DataFrame,
    rounds: int = 1,
    seed: int = SEED,
    label_prefix: str = "",
    dictionary: DataFrame | None = None,
    inline_bytes: int = INLINE_BYTES,
) -> DataFrame:
    """``rounds`` augmented copies of every row: ``row_id, round, input_sentence, train_label``.

    Every entity gets a name drawn from the dictionary of its tag, or keeps its own if a given
    dictionary lacks the tag. The draw is a hash of row,
    round, position and seed. The size of the dictionary decides between the two forms; both
    give the same rows.
    """
    if dictionary is None:
        dictionary = materialise(entity_dictionary(prepared), "dictionary")
    size = dictionary.agg(F.sum(F.octet_length("name") + F.octet_length("tag"))).first()[0] or 0
    if size > inline_bytes:
        return swap_joined(prepared, dictionary, rounds, seed, label_prefix)
    per_tag = dictionary.groupBy("tag").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "name"))), lambda n: n["name"]).alias("names")
    )
    entries = F.map_from_entries(F.collect_list(F.struct("tag", "names")))
    return swap_inline(prepared, per_tag.agg(F.to_json(entries)).first()[0], rounds, seed, label_prefix)


def augment(
    prepared: DataFrame, rounds: int = 1, seed: int = SEED, label_prefix: str = "", **options
) -> DataFrame:
    """The augmented copies (rounds 1 to ``rounds``) and the originals (round 0)."""
    originals = prepared.select("row_id", F.lit(0).alias("round"), "input_sentence", "train_label")
    if rounds == 0:
        return originals
    return swap_entities(prepared, rounds, seed, label_prefix, **options).unionByName(originals)
