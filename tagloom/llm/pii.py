"""Personal data by weak supervision, in built-in functions only.

Patterns find candidate spans: those of the base rules, base matches that fail a check, numbers in national
form and spelled-out addresses. Labelers (strict pattern, check digits, gazetteer, context words,
shape, borders) vote on each candidate or abstain. Votes and span features are small codes, so one
aggregate over all candidates gives a table of a few thousand rows at most; expectation-maximisation
on it estimates how reliable each labeler is, and the resulting soft labels train the final span
classifier (naive Bayes over span features). Base spans always stay; other candidates are added
where the classifier is sure and they overlap no base span.

Everything is row-local but that one aggregate; only codes and counts reach the driver.

Defined results: a null or empty text has no spans; repeated rows are judged alike; an empty table gives
no rows; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.arrays import let, positions
from tagloom.session import materialise

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:int,start:bigint,end:bigint,word:string,left:string,right:string,source:int>"

# An address or number cannot start inside a run that already failed from its first character, so
# a match starts after another match or at the start of a run; groups that need no way back are
# possessive. Both keep long runs linear and find what the plain patterns find.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further candidates, by the kind they would be.
MORE = {
    "email": r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[a-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORDS = {
    "email": "mail|write|contact|reach|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|pay|credit|account|charge",
    "phone": "call|phone|tel|fax|mobile|contact|reach",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ru|jp|cn|br|in)$",
    "ip": r"^(?:10|127|172|192|169|8)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
LABELERS = 6
SURE = 0.9
CONTEXT = 24
RUNNING = 128  # matches of a block of running totals


def _found(text: Column, pattern: str, hint: Column) -> Column:
    nothing = F.array().cast("array<string>")
    return F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing)


def _spans(matches: Column, pieces: Column, kind: int, source: int) -> Column:
    """Matches with offsets and neighbouring text; offsets add up over matches and pieces."""
    n = F.size(matches)
    parts = F.arrays_zip(
        matches.alias("word"), F.slice(pieces, 1, n).alias("left"), F.slice(pieces, 2, F.greatest(n, F.lit(0))).alias("right")
    )
    ends = _running(F.transform(parts, lambda p: (F.char_length(p["left"]) + F.char_length(p["word"])).cast("bigint")))

    def span(found: Column) -> Column:
        part, end = found["part"], found["end"]
        return F.struct(
            F.lit(kind).alias("kind"),
            (end - F.char_length(part["word"])).alias("start"),
            end.alias("end"),
            part["word"].alias("word"),
            F.right(part["left"], F.lit(CONTEXT)).alias("left"),
            F.left(part["right"], F.lit(1)).alias("right"),
            F.lit(source).alias("source"),
        )

    spans = F.transform(F.arrays_zip(parts.alias("part"), ends.alias("end")), span)
    return F.when(n > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _running(lengths: Column) -> Column:
    """Running totals of an array; arrays are only ever grown inside blocks, so the work follows the length."""
    empty = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint"))

    def inside(block: Column) -> Column:
        return F.aggregate(block, empty, lambda done, x: F.concat(done, F.array(x + last(done))))

    def joined(own: Column) -> Column:
        before = F.aggregate(own, F.array(F.lit(0).cast("bigint")), lambda done, x: F.concat(done, F.array(last(done) + last(x))))
        return F.flatten(
            F.transform(F.arrays_zip(own.alias("own"), F.slice(before, 1, F.size(own)).alias("before")), lambda b: F.transform(b["own"], lambda x: x + b["before"]))
        )

    def blocks(whole: Column) -> Column:
        return F.transform(positions(F.ceil(F.size(whole) / RUNNING).cast("int")), lambda i: inside(F.slice(whole, i * RUNNING + 1, F.lit(RUNNING))))

    return let(lengths, lambda whole: let(blocks(whole), joined))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Check digit of at most 19 digits."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")
    ).otherwise(F.try_to_number(d, F.lit("9")).cast("int") * 2))
    total = F.aggregate(places, F.lit(0), lambda n, x: n + F.coalesce(F.when(x > 9, x - 9).otherwise(x), F.lit(0)))
    return total % 10 == 0


def _valid(span: Column) -> Column:
    """The base rules' checks."""
    digits = _digits(span["word"])
    n = F.char_length(digits)
    return (
        F.when(span["kind"] == 0, True)
        .when(span["kind"] == 1, span["word"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(span["kind"] == 2, F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def _by_kind(span: Column, patterns: dict[str, str], on: Column) -> Column:
    out = F.lit(False)
    for k, kind in enumerate(KINDS):
        out = F.when(span["kind"] == k, on.rlike(patterns[kind])).otherwise(out)
    return out


def _votes(span: Column) -> list[Column]:
    """0 abstains, 1 votes against, 2 votes for."""
    digits = _digits(span["word"])
    number = span["kind"] > 0
    base = span["source"] == 0
    for_ = lambda yes, no=None: F.when(yes, 2).when(no if no is not None else F.lit(False), 1).otherwise(0)
    near = _by_kind(span, WORDS, F.lower(span["left"]))
    listed = _by_kind(span, GAZETTEER, F.when(number, F.regexp_replace(span["word"], r"^\D+", "")).otherwise(span["word"]))
    joined = span["left"].rlike(r"[\p{L}\p{N}_/=.-]$") | span["right"].rlike(r"^[\p{L}\p{N}_/=]")
    monotone = digits.rlike(r"^([0-9])\1*$") | F.lit("01234567890123456789").contains(digits)
    return [
        for_(base & _valid(span), base & ~_valid(span)),
        F.when(span["kind"] == 2, for_(_valid(span), ~_valid(span))).when(span["kind"] == 1, for_(_valid(span), ~_valid(span))).otherwise(0),
        for_(listed),
        for_(near),
        for_(F.lit(False), joined),
        F.when(number, for_(F.lit(False), monotone | (F.char_length(digits) < 7))).otherwise(0),
    ]


def _features(span: Column) -> list[tuple[Column, int]]:
    """Small codes and how many values each can take."""
    n = F.char_length(span["word"])
    border = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(3)
    return [
        (span["kind"], 4),
        (span["source"], 2),
        (F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3), 4),
        (border(F.right(span["left"], F.lit(1))), 4),
        (border(span["right"]), 4),
        (_valid(span).cast("int"), 2),
        (_by_kind(span, WORDS, F.lower(span["left"])).cast("int"), 2),
    ]


FEATURE_SIZES = (4, 2, 4, 4, 4, 2, 2)


def _code(digits: list[tuple[Column, int]]) -> Column:
    code = F.lit(0)
    for value, size in digits:
        code = code * size + value
    return code.cast("int")


def _uncode(code: int, sizes: tuple[int, ...]) -> tuple[int, ...]:
    out = []
    for size in reversed(sizes):
        code, value = divmod(code, size)
        out.append(value)
    return tuple(reversed(out))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, more``: valid base spans, and further candidates, each with its codes."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hints = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    matches, sources = [], []
    for source, patterns in enumerate((BASE, MORE)):
        for kind, pattern in patterns.items():
            hint = F.lit(True) if source else hints.get(kind, F.lit(True))
            matches.append(_found(text, pattern, hint).alias(f"m_{kind}{source}"))
            sources.append((f"{kind}{source}", KINDS.index(kind), source))
    # Matches first; the text is divided only where there are any.
    matched = rows.select("doc_id", "text", *matches)
    divided = matched.select(
        "doc_id",
        *[f"m_{name}" for name, _, _ in sources],
        *[
            F.when(F.size(f"m_{name}") > 0, F.split(text, (BASE, MORE)[s][KINDS[k]], -1))
            .otherwise(F.array().cast("array<string>"))
            .alias(f"p_{name}")
            for name, k, s in sources
        ],
    )
    spans = F.concat(*[_spans(F.col(f"m_{name}"), F.col(f"p_{name}"), k, s) for name, k, s in sources])
    found = divided.select("doc_id", spans.alias("spans"))
    coded = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            ((s["source"] == 0) & _valid(s)).alias("base"),
            _code([(v, 3) for v in _votes(s)]).alias("votes"),
            _code(_features(s)).alias("features"),
        ),
    )
    return found.select("doc_id", coded.alias("spans"))


@dataclass
class Labelers:
    """Chances of each vote given that a span is not, or is, personal data; share by kind."""

    chance: list[list[list[float]]]
    share: list[float]

    def posterior(self, kind: int, votes: tuple[int, ...]) -> float:
        odds = math.log(self.share[kind] / (1 - self.share[kind]))
        for labeler, v in zip(self.chance, votes):
            odds += math.log(labeler[1][v] / labeler[0][v])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def estimate(patterns: Counter, rounds: int = 30) -> Labelers:
    """Expectation-maximisation over counted ``(kind, votes)`` patterns.

    Starts from labelers that are right 4 times in 5, which also tells the two classes apart.
    """
    start = [[[0.3, 0.56, 0.14], [0.3, 0.14, 0.56]] for _ in range(LABELERS)]
    model = Labelers(start, [0.5] * len(KINDS))
    for _ in range(rounds):
        votes = [[[1.0] * 3 for _ in range(2)] for _ in range(LABELERS)]
        kinds = [[1.0, 1.0] for _ in KINDS]
        for (kind, pattern), n in patterns.items():
            yes = model.posterior(kind, pattern)
            kinds[kind][0] += n * (1 - yes)
            kinds[kind][1] += n * yes
            for i, v in enumerate(pattern):
                votes[i][0][v] += n * (1 - yes)
                votes[i][1][v] += n * yes
        chance = [[[x / sum(row) for x in row] for row in labeler] for labeler in votes]
        model = Labelers(chance, [k[1] / sum(k) for k in kinds])
    return model


def accepted_features(counts: list[tuple[int, int, int]]) -> list[int]:
    """Feature codes that the span classifier is sure of.

    ``counts``: votes code, features code, spans. Soft labels of the vote model train the classifier.
    """
    parsed = [(_uncode(v, (3,) * LABELERS), _uncode(f, FEATURE_SIZES), f, n) for v, f, n in counts]
    patterns: Counter = Counter()
    for votes, features, _, n in parsed:
        patterns[features[0], votes] += n
    model = estimate(patterns)
    seen: dict[tuple[int, int], list[float]] = defaultdict(lambda: [1.0, 1.0])
    totals = [2.0, 2.0]
    for votes, features, _, n in parsed:
        yes = model.posterior(features[0], votes)
        for y, w in ((0, n * (1 - yes)), (1, n * yes)):
            totals[y] += w
            for i, value in enumerate(features):
                seen[i, value][y] += w
    out = []
    for code in {f for _, _, f, _ in parsed}:
        odds = math.log(totals[1] / totals[0])
        for i, value in enumerate(_uncode(code, FEATURE_SIZES)):
            odds += math.log(seen[i, value][1] / totals[1]) - math.log(seen[i, value][0] / totals[0])
        if odds >= math.log(SURE / (1 - SURE)):
            out.append(code)
    return sorted(out)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def _number(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for each document."""
    found = materialise(candidates(docs), "pii-candidates")
    each = found.select(F.explode("spans").alias("s")).groupBy("s.votes", "s.features").agg(F.count(F.lit(1)).alias("n"))
    accepted = accepted_features([(r["votes"], r["features"], r["n"]) for r in each.collect()])
    base = F.filter("spans", lambda s: s["base"])
    allowed = F.array(*[F.lit(c) for c in accepted]).cast("array<int>")
    overlaps = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("spans", lambda s: ~s["base"] & F.array_contains(allowed, s["features"]) & ~overlaps(s))
    rows = found.select("doc_id", "spans", base.alias("base")).select("doc_id", "base", added.alias("added"))
    return rows.select(
        "doc_id",
        *[_number("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )
