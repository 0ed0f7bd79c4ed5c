"""Repair of conversations against exhaustive search."""

import hashlib
import random
import re
import sys
from functools import cache
from zlib import crc32

import numpy as np
import pytest

from tagloom.llm import turn_repair as tr

SPACES = "\t\n\x0b\x0c\r "
sys.setrecursionlimit(20_000)  # the search goes one call deeper with every edit


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = crc32(name.encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows, faults):
    """Least ``(cost, audit, repaired)`` by trying every edit, up to three inserted turns in a row."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @cache
    def rest(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def take(cost, audit, line, where):
            found.append((cost + where[0], audit + where[1], line + where[2]))

        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in after:
                    take(2, "I", (f"{role}:",), rest(i, after[state, role[0]], inserted + 1))
        if i < len(rows):
            role, text = rows[i]
            take(3, "D", (), rest(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if (state, role[:1]) in after:
                    take(extra, "K", (f"{role}:{text}",), rest(i + 1, after[state, role[:1]], 0))
                for other in ("user", "assistant"):
                    if (state, other[0]) in after:
                        take(2 + extra, "R", (f"{other}:{text}",), rest(i + 1, after[state, other[0]], 0))
        return min(found, default=(10**9, "", ()))

    return rest(0, 0, 0)


def brute(rows, ids):
    want = {}
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            last = text.strip(SPACES)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = zip([r[1][:1] for r in own], [r[1][:1] for r in own][1:])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, lines = cheapest([r[1:] for r in own], faults)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        want[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return want


def found(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.selectExpr("*", "1 AS conv", "1 AS place", "'x' AS edits").repartition(5)
    hurt = tr.damage_turns(turns)
    return {r.conv_id: tuple(r)[1:] for r in tr.repair_digest(tr.repair_turns(hurt), turns).collect()}


def conversations(rng, n, most):
    rows = []
    for conv in range(n):
        kind = rng.randrange(4)
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "system", None, "tool", ""]) if kind < 2 else ("user", "assistant")[turn % 2]
            role = "tool" if kind == 2 and turn else role
            text = rng.choice(["Yes.", "no", "a b!", "\t", f"t{turn}?", f"t{turn}", None, "é\nü."])
            rows.append((conv, turn // rng.choice([1, 1, 2]), role, text))
    return rows


@pytest.mark.parametrize("bits, fixups", [(7, 6), (2, 6), (2, 0)])
def test_repair_against_search(spark, monkeypatch, bits, fixups):
    """Few large blocks, many small ones with fix-up passes, and small ones by doubling alone."""
    monkeypatch.setattr(tr, "BLOCK_BITS", bits)
    monkeypatch.setattr(tr, "FIXUPS", fixups)
    rng = random.Random(bits + fixups)
    rows = conversations(rng, 40, 30) + [(None, t, "user", "x.") for t in (None, None, 3, 9)] + [(77, None, None, None)]
    assert found(spark, rows) == brute(damaged(rows), {r[0] for r in rows})


def test_a_conversation_over_many_chunks(spark, monkeypatch):
    """Rows that keep two phases apart never converge and take the products."""
    monkeypatch.setattr(tr, "BLOCK_BITS", 3)
    monkeypatch.setattr(tr, "FIXUPS", 2)
    rows = [(1, t, "tool", f"t{t}.") for t in range(300)] + [(2, t, "user", "same.") for t in range(300)]
    rows += [(3, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(300)]
    assert found(spark, rows) == brute(damaged(rows), {1, 2, 3})


def test_chunks_agree_with_whole_conversations():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 9, (50, 40)).astype(np.uint8)
    ends = np.tile(tr.END, (50, 1))
    whole = tr.backward(codes, ends)
    assert (tr.backward(codes[:, :13], tr.backward(codes[:, 13:], ends)) == whole).all()
    shifted = tr.backward(codes[:, :13], tr.level(tr.backward(codes[:, 13:], ends)))
    assert (tr.level(shifted) == tr.level(whole)).all()
    exits, edits = tr.trace(codes, ends)
    assert {len(e.split(",")) for chunk in edits for e in chunk} == {40} and exits.shape == (50, 4)


def test_query_against_search(spark, small):
    import __spark_entry__ as entry

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in entry.queries()["op12_turn_repair"](spark, small).collect()}
    assert got == brute(damaged(rows), {r[0] for r in rows})


def test_empty_table(spark):
    assert found(spark, []) == {}
