"""Language-model scoring with a gated recurrent network in numpy.

Words of the training rows are counted in full. The network reads the ``HEAD`` most frequent words (the
end of a text is one of them) and, for all others, one of ``TAILS`` classes by their last two bytes. Its
output is factored: a softmax over classes, then one over the words of a class of frequent words; in a
class of other words the counts give the share of a word, with one place for unknown words, as in the
base score. So every word of any text has a probability, and the vocabulary is not cut.

Training passes over all training rows. In a round each task starts from the shared parameters and
learns from its part of the rows by truncated backpropagation (windows of ``WINDOW`` steps, the
state carried from one window to the next); Spark averages the parameters of all tasks, weighted by their
tokens, in two steps per block of parameters. Only the averages, whose size is fixed, reach the driver.

Scoring carries the state across windows to the end of each text, however long. Counts of the ``KNOWN``
most frequent words are broadcast; the other words of a text are joined with the whole count table.

Defined results: a null or empty text has the end only; a null ``doc_id`` is neither held out nor learnt
from, as its remainder is unknown; repeated rows score alike; without training rows the base score is
0 for every text and the network gives its initial probabilities; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.workers import ship
from tagloom.session import materialise

# Sizes of the classes of frequent words, by falling count: the most frequent have few words to choose from.
SIZES = np.repeat([16, 32, 64, 128], 6)
CLASSES, HEAD = len(SIZES), int(SIZES.sum())
TAILS = 31  # classes of other words, a prime
HIDDEN = 12
END = 0
WINDOW, LANES = 16, 256  # of training
SCORE_WINDOW, SCORE_LANES = 32, 256
RATE = 0.1
ROUNDS = 3  # of averaging in a pass over the training rows
LEAST_TOKENS, MOST_PASSES = 4_000_000, 4  # small corpora are passed more than once
KNOWN, KNOWN_BYTES = 200_000, 64  # broadcast counts: words, and the longest of them
PIECE = 2048  # tokens of a long text that one lane learns from
SLICE_BYTES = 6 << 20  # of texts that a worker codes at once, about a million words
FLOATS = 4096  # parameters of a block
SMOOTHING = 0.1  # fixed value of the base score

CLASS_OF = np.concatenate([np.repeat(np.arange(CLASSES), SIZES), CLASSES + np.arange(TAILS)])
FIRST_OF = np.concatenate([[0], np.cumsum(SIZES)])
BLOCK = 1024  # rows of a block of class shares, which then stay in cache
MOST_WEIGHT, MOST_BIAS = 4.0, 10.0  # of outputs, so that no exponential overflows


def tail_column(word: Column) -> Column:
    return (F.conv(F.hex(F.substring(word.cast("binary"), -2, 2)), 16, 10).cast("bigint") % TAILS).cast("int")


def tails_of(words: pa.Array) -> np.ndarray:
    """The same for a column of words: the last two bytes as one number."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.empty(0, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last, before = (data[np.maximum(offsets[1:] - k, 0)].astype(np.int64) for k in (1, 2))
    before[np.diff(offsets) < 2] = 0
    return (256 * before + last) % TAILS


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, lower-cased, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    filled = pc.greater(pc.binary_length(words), 0)  # space at the ends of a text gives empty words
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    sizes = np.bincount(rows[filled.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return words.filter(filled), sizes


@dataclass
class Lexicon:
    """The frequent words by falling count, their counts, and totals of each tail class."""

    words: list[str]
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int
    tail_tokens: np.ndarray
    tail_distinct: np.ndarray

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "tail_total")}

    @cached_property
    def known(self) -> pa.Array:
        return pa.array(self.words, pa.string())

    def places(self, words: pa.Array, most: int | None = None) -> np.ndarray:
        """Of each word its place among the frequent words (the first ``most``), -1 if it is not there."""
        known = self.known if most is None else self.known[:most]
        return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)

    def ids(self, words: pa.Array, places: np.ndarray | None = None) -> np.ndarray:
        """Network ids."""
        places = self.places(words, HEAD - 1) if places is None else places
        return np.where((places >= 0) & (places < HEAD - 1), places + 1, HEAD + tails_of(words))

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, with the end."""
        bounds = np.concatenate(([0], np.cumsum(sizes))).tolist()
        return [np.append(ids[a:b], END) for a, b in zip(bounds, bounds[1:])]

    @cached_property
    def tail_total(self) -> np.ndarray:
        return self.tail_tokens + SMOOTHING * (self.tail_distinct + 1)


def _softmax(rows: np.ndarray, weights: np.ndarray, own: np.ndarray, learning: bool):
    """Log-share of ``own``; the gradients for weights and rows without the part of the own choice."""
    shares = rows @ weights.T
    score = shares[np.arange(len(own)), own]
    np.exp(shares, out=shares)
    total = shares.sum(1)
    score -= np.log(total)
    if not learning:
        return score, None, None
    total = total[:, None]
    return score, shares.T @ (rows / total), (shares @ weights[:, :HIDDEN]) / total


@dataclass
class Network:
    """Parameters, and for each the sum of squared gradients that sets its learning rate."""

    values: dict[str, np.ndarray]
    squares: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, lexicon: Lexicon) -> Network:
        """Small random weights; biases that give the unigram shares."""
        rng = np.random.default_rng(13)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        counts = np.zeros(HEAD)
        counts[END] = lexicon.ends
        own = lexicon.counts[: HEAD - 1]
        counts[1 : len(own) + 1] = own
        masses = np.concatenate([np.add.reduceat(counts, FIRST_OF[:-1]), lexicon.tail_total]) + SMOOTHING
        logs = np.where(counts > 0, np.log(np.maximum(counts, 1)), -30)
        logs -= np.repeat(np.maximum.reduceat(logs, FIRST_OF[:-1]), SIZES)
        values = {
            "embedding": draw(HEAD + TAILS, HIDDEN),
            "input": draw(HIDDEN, 3 * HIDDEN),
            "bias": np.zeros(3 * HIDDEN, np.float32),
            "gates": draw(HIDDEN, 2 * HIDDEN),
            "candidate": draw(HIDDEN, HIDDEN),
            # The last column is the bias.
            "classes": np.column_stack([draw(CLASSES + TAILS, HIDDEN), np.log(masses / masses.sum())]).astype(np.float32),
            "words": np.column_stack([draw(HEAD, HIDDEN), logs]).astype(np.float32),
        }
        return cls(values, {k: np.full_like(v, 1e-2) for k, v in values.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for part in (self.values, self.squares) for x in part.values()])

    def filled(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for part in (self.values, self.squares):
            made = {}
            for name, x in part.items():
                made[name] = flat[at : at + x.size].reshape(x.shape).copy()
                at += x.size
            parts.append(made)
        return Network(*parts)

    def states(self, read: np.ndarray, h: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden states after reading ``read`` (steps x lanes), and the last one; zero before the first word of a text.

        States are hidden x lanes, so that gates are contiguous; the first result is steps x lanes x hidden.
        """
        v = self.values
        steps, lanes = read.shape
        table = np.ascontiguousarray((v["embedding"] @ v["input"] + v["bias"]).T)
        x = table[:, read]
        inner = (read != END).astype(table.dtype)
        gates, candidate = (np.ascontiguousarray(v[k].T) for k in ("gates", "candidate"))
        out = np.empty((steps, HIDDEN, lanes), table.dtype)
        saved = {k: np.empty((steps, HIDDEN, lanes), table.dtype) for k in ("h", "z", "r", "n")} if keep is not None else None
        half = table.dtype.type(0.5)
        for t in range(steps):
            h = h * inner[t]
            gate = gates @ h
            gate += x[: 2 * HIDDEN, t]
            gate *= half
            np.tanh(gate, out=gate)
            gate += 1
            gate *= half
            z, r = gate[:HIDDEN], gate[HIDDEN:]
            n = candidate @ (r * h)
            n += x[2 * HIDDEN :, t]
            np.tanh(n, out=n)
            if saved is not None:
                saved["h"][t], saved["z"][t], saved["r"][t], saved["n"][t] = h, z, r, n
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        if keep is not None:
            keep.update(saved, inner=inner)
        return out.transpose(0, 2, 1), h

    def predict(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each target (tail words: of their class), and the gradient for ``h``.

        Rows are sorted by target, so the rows of a class, and those of a word, lie side by side.
        """
        classes, words = self.values["classes"], self.values["words"]
        order = np.argsort(target, kind="stable")
        ids = target[order]
        own = CLASS_OF[ids]
        rows = np.column_stack([h[order], np.ones(len(ids), h.dtype)])
        score = np.empty(len(ids), h.dtype)
        learning = grads is not None
        if learning:
            grads["classes"], grads["words"] = np.zeros_like(classes), np.zeros_like(words)
            dh = np.empty_like(h)
        for at in range(0, len(ids), BLOCK):
            part = slice(at, at + BLOCK)
            score[part], slope, deep = _softmax(rows[part], classes, own[part], learning)
            if learning:
                grads["classes"] += slope
                dh[part] = deep
        heads = int(np.searchsorted(ids, HEAD))
        bounds = np.searchsorted(ids[:heads], FIRST_OF)
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            part, inside = slice(bounds[c], bounds[c + 1]), slice(FIRST_OF[c], FIRST_OF[c + 1])
            more, slope, deep = _softmax(rows[part], words[inside], ids[part] - FIRST_OF[c], learning)
            score[part] += more
            if learning:
                grads["words"][inside] = slope
                dh[part] += deep
        back = np.empty_like(score)
        back[order] = score
        if not learning:
            return back, None
        for name, key in (("classes", own), ("words", ids[:heads])):
            if len(key):
                starts = np.flatnonzero(np.diff(key, prepend=-1))
                grads[name][key[starts]] -= np.add.reduceat(rows[: len(key)], starts)
                dh[: len(key)] -= self.values[name][key, :HIDDEN]
        unsorted = np.empty_like(dh)
        unsorted[order] = dh
        return back, unsorted

    def learn(self, read: np.ndarray, target: np.ndarray, used: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One step on a window; returns the state after it."""
        v, keep, grads = self.values, {}, {}
        out, last = self.states(read, h, keep)
        steps, lanes = read.shape
        dout = np.zeros((steps, lanes, HIDDEN), out.dtype)
        dout[used] = self.predict(out[used], target[used], grads)[1]
        dout = np.ascontiguousarray(dout.transpose(0, 2, 1))
        dx = np.empty((steps, 3 * HIDDEN, lanes), out.dtype)
        carry = np.zeros((HIDDEN, lanes), out.dtype)
        for t in range(steps - 1, -1, -1):
            before, z, r, n = (keep[k][t] for k in ("h", "z", "r", "n"))
            dh = dout[t]
            dh += carry
            dz, dr, dn = dx[t, :HIDDEN], dx[t, HIDDEN : 2 * HIDDEN], dx[t, 2 * HIDDEN :]
            np.multiply(dh, 1 - z, out=dn)
            dn *= 1 - n * n
            dmixed = v["candidate"] @ dn
            np.subtract(before, n, out=dz)
            dz *= dh
            dz *= z
            dz *= 1 - z
            np.multiply(dmixed, before, out=dr)
            dr *= r
            dr *= 1 - r
            carry = v["gates"] @ dx[t, : 2 * HIDDEN]
            dmixed *= r
            carry += dmixed
            dh *= z
            carry += dh
            carry *= keep["inner"][t]
        turned = dx.transpose(0, 2, 1)
        grads["gates"] = (keep["h"] @ turned[:, :, : 2 * HIDDEN]).sum(0)
        grads["candidate"] = ((keep["r"] * keep["h"]) @ turned[:, :, 2 * HIDDEN :]).sum(0)
        # All reads of a word share its embedding, so their gradients are added first.
        ids = read.ravel()
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        rows = ids[order][starts]
        per_word = np.add.reduceat(turned.reshape(-1, 3 * HIDDEN)[order], starts)
        grads["input"], grads["bias"] = v["embedding"][rows].T @ per_word, per_word.sum(0)
        deep = per_word @ v["input"].T
        for name, grad in grads.items():
            self.squares[name] += grad * grad
            v[name] -= RATE * grad / np.sqrt(self.squares[name])
        for name in ("classes", "words"):
            np.clip(v[name][:, :HIDDEN], -MOST_WEIGHT, MOST_WEIGHT, out=v[name][:, :HIDDEN])
            np.minimum(v[name][:, HIDDEN], MOST_BIAS, out=v[name][:, HIDDEN])
        self.squares["embedding"][rows] += deep * deep
        v["embedding"][rows] -= RATE * deep / np.sqrt(self.squares["embedding"][rows])
        return last


def lay_out(sizes: list[int], lanes: int) -> list[list[int]]:
    """Texts of each lane, longest lane first; every text goes to the shortest lane so far."""
    heap = [(0, k) for k in range(min(lanes, len(sizes)))]
    laid: list[list[int]] = [[] for _ in heap]
    held = [0] * len(heap)
    for d in sorted(range(len(sizes)), key=lambda d: -sizes[d]):
        n, k = heapq.heappop(heap)
        laid[k].append(d)
        held[k] = n + sizes[d]
        heapq.heappush(heap, (held[k], k))
    return [laid[k] for k in sorted(range(len(laid)), key=lambda k: -held[k])]


def _windows(texts: list[np.ndarray], lanes: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Steps x lanes of ``read, target, place`` (in the texts laid end to end; -1 beyond a lane's end)."""
    laid = lay_out([len(t) for t in texts], lanes)
    firsts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    places = [np.concatenate([np.arange(firsts[d], firsts[d + 1]) for d in lane]) for lane in laid]
    flat = np.concatenate(texts)
    before = np.concatenate(([END], flat[:-1]))
    before[firsts[:-1]] = END
    for at in range(0, len(places[0]), window):
        active = [p[at : at + window] for p in places if len(p) > at]
        steps = len(active[0])
        place = np.full((len(active), steps), -1)
        for k, p in enumerate(active):
            place[k, : len(p)] = p
        place = np.ascontiguousarray(place.T)
        yield np.where(place < 0, END, before[place]), flat[place], place


def train(network: Network, texts: list[np.ndarray]) -> None:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    h = np.zeros((HIDDEN, min(LANES, len(pieces))), np.float32)
    for read, target, place in _windows(pieces, LANES, WINDOW):
        h = network.learn(read, target, place >= 0, h[:, : read.shape[1]])


def log_likelihood(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of every id, given those before it in its text, laid end to end."""
    score = np.zeros(sum(map(len, texts)))
    h = np.zeros((HIDDEN, min(SCORE_LANES, len(texts))), np.float32)
    for read, target, place in _windows(texts, SCORE_LANES, SCORE_WINDOW):
        out, h = network.states(read, h[:, : read.shape[1]])
        inside = place >= 0
        score[place[inside]] = network.predict(out[inside], target[inside])[0]
    return score


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with texts of ``SLICE_BYTES`` at a time; a longer text comes alone."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()):
        if i > first and held + n > SLICE_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(batch) > first:
        yield batch.slice(first)


def _held_out(doc_id: Column) -> Column:
    """Null for a null ``doc_id``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` over all rows, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = pc.value_counts(words_of(part["text"])[0])
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    partial = texts.select("text").mapInArrow(run, "word string, n bigint")
    return materialise(partial.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def build_lexicon(counts: DataFrame, ends: int) -> Lexicon:
    short = counts.filter(F.octet_length("word") <= KNOWN_BYTES)
    top = short.orderBy(F.col("n").desc(), "word").limit(KNOWN).toArrow()
    words = top["word"].to_pylist()
    own = top["n"].to_numpy().astype(np.int64)
    tokens, distinct = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for tail, n, v in counts.groupBy(tail_column(F.col("word"))).agg(F.sum("n"), F.count(F.lit(1))).collect():
        tokens[tail], distinct[tail] = n, v
    total, kinds = int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0)
    tails = tails_of(pa.array(words[: HEAD - 1], pa.string()))
    tokens -= np.bincount(tails, own[: HEAD - 1], TAILS).astype(np.int64)
    distinct -= np.bincount(tails, minlength=TAILS)
    return Lexicon(words, own, total, kinds, ends, tokens, distinct)


def _learnt(rows: DataFrame, lexicon, network: Network) -> Network:
    """Average of the networks that all tasks learnt from their rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(network)
    schema = "lane int, block int, tokens double, mean binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = shared.value.filled(shared.value.flat()), 0
        for batch in batches:
            for part in _slices(batch):
                words, sizes = words_of(part["text"])
                train(own, lexicon.value.texts(lexicon.value.ids(words), sizes))
                tokens += len(words) + len(sizes)
        if tokens:
            flat = own.flat()
            blocks = [flat[i : i + FLOATS].tobytes() for i in range(0, len(flat), FLOATS)]
            n = len(blocks)
            lane = TaskContext.get().partitionId() % 64
            columns = [pa.array([lane] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([float(tokens)] * n), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lane", "block", "tokens", "mean"])

    def add(group: pa.Table) -> pa.Table:
        tokens = group["tokens"].to_pylist()
        mean = sum(np.frombuffer(x.as_py(), np.float32) * np.float64(n) for x, n in zip(group["mean"], tokens)) / sum(tokens)
        row = {"lane": [0], "block": [group["block"][0].as_py()], "tokens": [sum(tokens)], "mean": [mean.astype(np.float32).tobytes()]}
        return pa.table(row, schema=pa.schema([("lane", pa.int32()), ("block", pa.int32()), ("tokens", pa.float64()), ("mean", pa.binary())]))

    learnt = rows.select("text").mapInArrow(run, schema)
    by_lane = learnt.groupBy("lane", "block").applyInArrow(add, schema)
    blocks = by_lane.groupBy("block").applyInArrow(add, schema).collect()
    if not blocks:
        return network
    return network.filled(np.concatenate([np.frombuffer(r["mean"], np.float32) for r in sorted(blocks, key=lambda r: r["block"])]))


def fit(rows: DataFrame, lexicon, passes: int) -> Network:
    """``rows`` have a ``part`` in ``[0, ROUNDS)``; ``lexicon`` is broadcast."""
    network = Network.start(lexicon.value)
    for k in range(passes * ROUNDS):
        network = _learnt(rows.filter(F.col("part") == k % ROUNDS), lexicon, network)
    return network


SCORED = (
    "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, "
    "open array<struct<word: string, n: bigint>>"
)


def _scored(rows: DataFrame, lexicon, network: Network) -> DataFrame:
    """Sums over the words whose counts are broadcast, and the others with their multiplicities."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    kind = rows.select("doc_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        all_log = math.log10(lex.tokens + SMOOTHING * (lex.distinct + 1))
        own_log = np.append(np.log10(lex.counts + SMOOTHING), 0.0)  # an open word adds its part later
        tail_log = np.log10(lex.tail_total)
        end_log = math.log10(lex.ends + SMOOTHING)
        for batch in batches:
            for part in _slices(batch):
                words, sizes = words_of(part["text"])
                places, n = lex.places(words), len(sizes)
                ids, line = lex.ids(words, places), np.repeat(np.arange(n), sizes)
                steps = log_likelihood(shared.value, lex.texts(ids, sizes)) / math.log(10)
                counted = own_log[places]
                base = np.bincount(line, counted, n) + end_log - (sizes + 1) * all_log
                tail = np.flatnonzero(ids >= HEAD)
                model = np.add.reduceat(steps, np.concatenate(([0], np.cumsum(sizes + 1)[:-1])))
                model += np.bincount(line[tail], counted[tail] - tail_log[ids[tail] - HEAD], n)
                unknown = np.flatnonzero(places < 0)
                known = sizes + (lex.ends > 0) - np.bincount(line[unknown], minlength=n)
                found = [sizes + 1, known, base, model]
                columns = [part["doc_id"], part["held_out"], *map(pa.array, found), _listed(line[unknown], words.take(pa.array(unknown)), n)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in names])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "open"]
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, SCORED.replace("doc_id string", f"doc_id {kind}"))


def _listed(line: np.ndarray, words: pa.Array, n: int) -> pa.Array:
    """Per row its distinct words with their numbers."""
    table = pa.table({"line": line, "word": words}).group_by(["line", "word"]).aggregate([("word", "count")]).sort_by("line")
    offsets = np.searchsorted(table["line"].to_numpy(), np.arange(n + 1))
    parts = [table["word"].combine_chunks(), table["word_count"].combine_chunks()]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["word", "n"]))


def language_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    ship(spark)
    held_out = _held_out(F.col("doc_id"))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS))
    training = rows.filter("NOT held_out").withColumn("part", part)
    counts = count_words(training)
    found = build_lexicon(counts, training.count())
    lexicon = spark.sparkContext.broadcast(found)
    passes = min(MOST_PASSES, math.ceil(LEAST_TOKENS / max(found.tokens, 1)))
    network = fit(training, lexicon, passes)
    scored = _scored(rows.withColumn("held_out", F.coalesce("held_out", F.lit(False))), lexicon, network)
    stored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    words = stored.select("row", F.explode("open").alias("open")).select("row", "open.word", F.col("open.n").alias("times"))
    log = F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)
    rest = words.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * log).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    more = F.coalesce("more", F.lit(0.0))
    return stored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(found.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
