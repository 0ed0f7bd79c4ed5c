"""Conversation structure repair by rank-convergence parallel Viterbi.

A repaired conversation has the role initials ``(s?(ua)+)?``: four states (empty, after ``s``, after
``u``, after ``a``). Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3 (forced for blank
and duplicate rows), Insert an empty user or assistant turn 2; a truncated row that stays adds 1. Of
all cheapest edit sequences the one with the ASCII-least initials is taken.

Rows are sorted by range, so a conversation may span any number of partitions; ``BLOCK`` neighbouring
places form a block, and the rows of a conversation in a block a chunk. Each chunk computes the costs
of reaching a legal end backwards, row by row, for all chunks of a batch at once in numpy. The last
chunk of a conversation starts from the true costs, all others from a speculative vector of zeros. A
fix-up pass hands every chunk the vector its successor arrived at; chunks rerun whose vector differs by more
than a constant, until none does. A constant changes no decision, so the stitched vectors drive the
tracing: at each row the ASCII-least edit that keeps to the cheapest costs. Chunks trace all four
entry states and are linked by their exits.

Some rows never converge (a long stretch of unknown roles keeps its parity). Conversations still open
after ``FIXUPS`` passes get their vectors from min-plus products of chunk matrices, and entry states from
products of exit maps, by doubling: logarithmically many passes, exact. Chunks of forced deletions only
change no vector and are left out.

Defined results: null role and text count as one space; a role whose first character is not s, u or a
(also an empty one) cannot be kept; equal turns are ordered by role, then text, null turns come
first; rows with a null ``conv_id`` form one conversation; an empty table gives no rows; other columns are
ignored. Digests are sequential sums, so ``repair_digest`` streams a conversation through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.workers import ship
from tagloom.session import materialise

BLOCK_BITS = 7
BLOCK = 1 << BLOCK_BITS  # places of a block
FIXUPS = 6

STATES, FAR = 4, 1 << 20
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
# States: 0 empty, 1 after s, 2 after u, 3 after a. Where each initial leads, -1 nowhere.
AFTER = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "x": (-1, -1, -1, -1)}
INITIALS = "suax"
FORCED, NONE = 8, 9  # codes: initial, plus 4 if truncated; forced deletion; padding
END = np.array([0, 4, 2, 0], np.int64)  # cost of a legal end from each state
TAIL = ("", "ua", "a", "")  # the turns inserted there
# Edits: D delete, K keep, U A rerole to user or assistant, u a insert user or assistant.
EDIT_INITIALS = str.maketrans("UAua", "RRII")
ROLES = {"U": "user", "A": "assistant", "u": "user", "a": "assistant"}
SPACES = "\t\n\x0b\x0c\r "
LAST_PLACE = 1 << 62


def _choices(code: int, state: int) -> list[tuple[str, int, int]]:
    """``(edits, cost, next state)`` of one row, ASCII-least initials first."""
    if code == NONE:
        return [("", 0, state)]
    found = [("D", DELETE, state)]
    if code != FORCED:
        extra = TRUNCATED * (code >= 4)
        before, cost = "", extra
        for _ in range(3):  # with none, one or two inserted turns ahead of the row
            kept = AFTER[INITIALS[code % 4]][state]
            if kept >= 0:
                found.append((before + "K", cost, kept))
            user = state != 2
            found.append((before + ("U" if user else "A"), cost + REROLE, 2 if user else 3))
            before, cost, state = before + ("u" if user else "a"), cost + INSERT, 2 if user else 3
    return sorted(found, key=lambda c: c[0].translate(EDIT_INITIALS))


CHOICES = [[_choices(code, state) for state in range(STATES)] for code in range(NONE + 1)]
WIDTH = max(len(c) for row in CHOICES for c in row)
COST = np.array([[[c[1] for c in own] + [FAR] * (WIDTH - len(own)) for own in row] for row in CHOICES])
NEXT = np.array([[[c[2] for c in own] + [0] * (WIDTH - len(own)) for own in row] for row in CHOICES])


def _codes(chunks: list[str]) -> np.ndarray:
    width = max(map(len, chunks), default=0)
    flat = "".join(c.ljust(width, str(NONE)) for c in chunks).encode()
    return (np.frombuffer(flat, np.uint8) - ord("0")).reshape(len(chunks), width)


def _step(codes: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Costs of every choice at one row of each chunk, given the costs after the row."""
    after = np.take_along_axis(ahead[:, None, :], NEXT[codes].reshape(len(codes), 1, -1), 2)
    return COST[codes] + after.reshape(len(codes), STATES, WIDTH)


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs at the start of each chunk from the costs at its end."""
    costs = ends
    for k in range(codes.shape[1] - 1, -1, -1):
        costs = _step(codes[:, k], costs).min(2)
    return np.minimum(costs, FAR)


def level(costs: np.ndarray) -> np.ndarray:
    """Vectors that differ only by a constant become equal."""
    return costs - costs.min(1, keepdims=True)


def trace(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """By entry state, the exit state and the edits of every row, comma-joined."""
    n, width = codes.shape
    best = np.empty((width, n, STATES), np.int8)
    costs = ends
    for k in range(width - 1, -1, -1):
        options = _step(codes[:, k], costs)
        best[k] = options.argmin(2)  # the first of equals has the least initials
        costs = np.take_along_axis(options, best[k][:, :, None].astype(np.int64), 2)[:, :, 0]
    state = np.tile(np.arange(STATES), (n, 1))
    rows = np.arange(n)[:, None]
    edits: list[list[list[str]]] = [[[] for _ in range(STATES)] for _ in range(n)]
    for k in range(width):
        taken = best[k][rows, state]
        for i, (code, states, picks) in enumerate(zip(codes[:, k].tolist(), state.tolist(), taken.tolist())):
            if code != NONE:
                for own, s, pick in zip(edits[i], states, picks):
                    own.append(CHOICES[code][s][pick][0])
        state = NEXT[codes[:, k][:, None], state, taken]
    return state, [[",".join(own) for own in chunk] for chunk in edits]


def _vectors(column: pa.Array, width: int = STATES) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(values.reshape(-1), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * (values.size // max(len(values), 1)), pa.int32()), flat)


def _run(codes: Column, ends: Column) -> Column:
    def run(chunks: pa.Array, vectors: pa.Array) -> pa.Array:
        return _lists(level(backward(_codes(chunks.to_pylist()), _vectors(vectors))))

    return F.arrow_udf(run, "array<bigint>")(codes, ends)


def _matrices(codes: Column) -> Column:
    """Costs from each state at the start of a chunk to each state at its end."""

    def run(chunks: pa.Array) -> pa.Array:
        own = _codes(chunks.to_pylist())
        ends = np.where(np.eye(STATES, dtype=bool), 0, FAR)
        columns = [backward(own, np.tile(ends[t], (len(own), 1))) for t in range(STATES)]
        return _lists(np.stack(columns, 2).reshape(len(own), -1))

    return F.arrow_udf(run, "array<bigint>")(codes)


def _product(first: Column, second: Column) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (_vectors(m, STATES * STATES).reshape(-1, STATES, STATES) for m in (a, b))
        both = np.minimum((x[:, :, :, None] + y[:, None, :, :]).min(2), FAR)
        return _lists(both.reshape(len(both), -1))

    return F.arrow_udf(run, "array<bigint>")(first, second)


def _traced(codes: Column, ends: Column) -> Column:
    def run(chunks: pa.Array, vectors: pa.Array) -> pa.Array:
        exits, edits = trace(_codes(chunks.to_pylist()), _vectors(vectors))
        return pa.StructArray.from_arrays([_lists(exits), pa.array(edits, pa.list_(pa.string()))], ["exits", "edits"])

    return F.arrow_udf(run, "struct<exits: array<bigint>, edits: array<string>>")(codes, ends)


def _vector(values: np.ndarray) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>")


def _conversation(conv_id: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def _arranged(turns: DataFrame) -> DataFrame:
    """Rows with their ``place``: partitions by range, then rows in order; written once."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = turns.select(
        "conv_id",
        _conversation(F.col("conv_id")).alias("conv"),
        "turn",
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(placed.withColumn("place", F.monotonically_increasing_id()), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """``conv, place, fault, code``: narrow rows; the first of equal rows is found per conversation."""
    ending = F.btrim("text", F.lit(SPACES))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    content = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    seen = rows.select(
        "conv",
        "place",
        content.alias("content"),
        F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3).alias("initial"),
        (ending == "").alias("blank"),
        (~F.substring(ending, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    firsts = seen.groupBy("conv", "content").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(FORCED)).otherwise(
        F.col("initial") + F.when(F.col("fault").isNull(), 0).otherwise(4)
    )
    known = seen.join(firsts, "place", "left").withColumn("fault", fault)
    return materialise(known.select("conv", "place", "fault", code.cast("int").alias("code")), "faults")


def _chunks(faults: DataFrame) -> DataFrame:
    """Chunks with a row that is not deleted anyway, numbered in each conversation."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda r: r["code"].cast("string"))
    chunks = faults.groupBy("conv", F.shiftright("place", BLOCK_BITS).alias("block")).agg(
        F.min("place").alias("first"), F.array_join(listed, "").alias("codes")
    )
    part = F.shiftright("block", 33 - BLOCK_BITS)
    live = chunks.filter(F.col("codes").rlike("[0-7]")).withColumn("part", part)
    by_conv = Window.partitionBy("conv")
    earlier = by_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = live.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.sum("n").over(by_conv).alias("total")
    )
    local = F.row_number().over(Window.partitionBy("conv", "part").orderBy("block")) - 1
    numbered = live.withColumn("local", local).join(counts, ["conv", "part"])
    return numbered.select("conv", "first", "codes", (F.col("offset") + F.col("local")).alias("seq"), "total")


def _beside(chunks: DataFrame, step: int, column: str, name: str) -> DataFrame:
    """Adds the neighbour's ``column``, ``step`` chunks further in the conversation; null beyond its ends."""
    other = chunks.select("conv", (F.col("seq") - step).alias("seq"), F.col(column).alias(name))
    return chunks.join(other, ["conv", "seq"], "left")


def _is_empty(rows: DataFrame) -> bool:
    return not rows.limit(1).count()


def _settled(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Chunks with the costs ``ends`` after them, right up to a constant; the number of fix-up passes."""
    true_end = F.col("seq") == F.col("total") - 1
    ends = F.when(true_end, _vector(level(END[None])[0])).otherwise(_vector(np.zeros(STATES)))
    state = chunks.withColumn("ends", ends)
    state = materialise(state.withColumn("starts", _run(F.col("codes"), F.col("ends"))), "vectors")
    alone, many = state.filter("total = 1"), state.filter("total > 1")
    for done in range(FIXUPS):
        fixed = _beside(many, 1, "starts", "given")
        stale = F.col("given").isNotNull() & (F.col("given") != F.col("ends"))
        if _is_empty(fixed.filter(stale)):
            return alone.unionByName(many), done
        # Only the chunks with another vector run again.
        again = fixed.filter(stale).select(*chunks.columns, F.col("given").alias("ends"))
        again = again.withColumn("starts", _run(F.col("codes"), F.col("ends")))
        many = materialise(fixed.filter(~stale).drop("given").unionByName(again), "vectors")
    return alone.unionByName(_multiplied(many)), FIXUPS


def _multiplied(many: DataFrame) -> DataFrame:
    """The same by products of matrices over doubled distances."""
    state = materialise(many.drop("ends", "starts").withColumn("matrix", _matrices(F.col("codes"))), "matrices")
    longest = many.agg(F.max("total")).first()[0] or 0
    step = 1
    while step < longest:
        other = _beside(state, step, "matrix", "other")
        joined = F.when(F.col("other").isNull(), F.col("matrix")).otherwise(
            _product(F.col("matrix"), F.coalesce("other", "matrix"))
        )
        state = materialise(other.withColumn("matrix", joined).drop("other"), "matrices")
        step *= 2

    def arrive(matrices: pa.Array) -> pa.Array:
        own = _vectors(matrices, STATES * STATES).reshape(-1, STATES, STATES)
        return _lists(level((own + END).min(2)))

    starts = state.withColumn("starts", F.arrow_udf(arrive, "array<bigint>")(F.col("matrix"))).drop("matrix")
    given = _beside(starts, 1, "starts", "given")
    return given.select(*[c for c in starts.columns if c != "starts"], F.coalesce("given", _vector(level(END[None])[0])).alias("ends"), "starts")


def _entered(traced: DataFrame) -> DataFrame:
    """Adds the state ``entry`` in which each chunk is reached."""
    state = traced.withColumn("path", F.col("exits"))
    middle = (F.col("seq") > 0) & (F.col("seq") < F.col("total") - 1)
    depends = middle & (F.size(F.array_distinct("path")) > 1)
    step = 1
    while not _is_empty(state.filter(depends & (F.col("seq") >= step))):
        # Chunks 0..seq compose their exit maps; after step doublings a path covers 2 * step chunks.
        other = _beside(state, -step, "path", "before")
        path = F.when(F.col("before").isNull(), F.col("path")).otherwise(
            F.transform("before", lambda s: F.get("path", s.cast("int")))
        )
        state = materialise(other.withColumn("path", path).drop("before"), "paths")
        step *= 2
    given = _beside(state, -1, "path", "before")
    # The first chunk starts empty; a path that does not reach back to it has one exit only.
    return given.withColumn("entry", F.coalesce(F.get("before", F.lit(0)), F.lit(0)).cast("int")).drop("before", "path")


def repair_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text, fault, edits``, in the order of ``place`` in a conversation.

    ``edits`` holds the turns to insert ahead of a row and what becomes of it; turns inserted at the
    end come in a row of their own, whose role is null.
    """
    ship(turns.sparkSession)
    rows = _arranged(turns)
    faults = _faults(rows)
    settled, _ = _settled(_chunks(faults))
    traced = materialise(
        settled.withColumn("traced", _traced(F.col("codes"), F.col("ends"))).select(
            "conv", "seq", "total", "first", "traced.exits", "traced.edits"
        ),
        "traced",
    )
    entered = _entered(traced)
    edits = entered.select("first", F.posexplode(F.split(F.get("edits", F.col("entry")), ",")).alias("k", "edits"))
    decided = edits.select((F.col("first") + F.col("k")).alias("place"), "edits")
    edited = rows.join(faults.select("place", "fault"), "place").join(decided, "place", "left")
    edited = edited.withColumn("edits", F.coalesce("edits", F.lit("D")))
    final = F.get("exits", F.col("entry")).cast("int")
    tails = F.get(F.array(*map(F.lit, TAIL)), final)
    conv_id = F.when(F.col("conv") != "null", F.substring("conv", 2, 1 << 30))
    last = entered.filter(F.col("seq") == F.col("total") - 1).select(
        conv_id.cast(turns.select("conv_id").schema[0].dataType).alias("conv_id"), F.lit(LAST_PLACE).alias("place"), tails.alias("edits")
    )
    return edited.drop("conv").unionByName(last.filter("edits <> ''"), allowMissingColumns=True)


class _Report:
    """Running counts and digest of one conversation."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.distinct = self.kept = 0
        self.low = self.high = self.before = None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.digest.update(("\n" * (self.kept > 0) + f"{role}:{text}").encode())
        self.kept += 1

    def add(self, turn: int | None, role: str | None, text: str | None, fault: str | None, edits: str) -> None:
        if role is not None:
            if fault:
                self.counts[fault] += 1
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.distinct = turn, self.distinct + 1
            self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
        self.audit.append(edits.translate(EDIT_INITIALS))
        for edit in edits:
            if edit == "D":
                self.cost += DELETE
            elif edit in "ua":
                self.cost += INSERT
                self._write(ROLES[edit], "")
            else:
                self.cost += (REROLE if edit in ROLES else 0) + TRUNCATED * (fault == "truncated")
                self._write(ROLES.get(edit, role), text)

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


DIGEST = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


def repair_digest(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``, also those without rows in ``repaired``."""
    field = conversations.select("conv_id").schema[0]
    kind = to_arrow_type(field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *(f.split()[0] for f in DIGEST.split(", "))]
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        key, now = None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            done = []
            columns = [batch[c].to_pylist() for c in ("conv", "conv_id", "turn", "role", "text", "fault", "edits")]
            for conv, conv_id, *row in zip(*columns):
                if conv != key:
                    if now is not None:
                        done.append(now.row())
                    key, now = conv, _Report(conv_id)
                if row[-1] is not None:
                    now.add(*row)
            if done:
                yield made(done)
        if now is not None:
            yield made([now.row()])

    ship(repaired.sparkSession)
    marks = conversations.select(F.col("conv_id")).distinct().withColumn("place", F.lit(-1).cast("bigint"))
    rows = repaired.unionByName(marks, allowMissingColumns=True).withColumn("conv", _conversation(F.col("conv_id")))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "place")
    listed = rows.select("conv", "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "fault", "edits")
    return listed.mapInArrow(run, f"conv_id {field.dataType.simpleString()}, {DIGEST}")


def damage_turns(turns: DataFrame) -> DataFrame:
    """A fifth of the rows dropped, emptied, stripped of sentence ends, repeated or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return (
        turns.select("conv_id", "turn", fault.alias("fault"), role.alias("role"), text.alias("text"))
        .filter("fault <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fault") == 1, "")
            .when(F.col("fault") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )
