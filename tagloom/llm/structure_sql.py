"""SQL of the queries on periodic runs and on the repair of conversations, for an independent engine."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda c, x: {step}), 4294967295)"


OP11_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    {crc32("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents
), drawn AS (SELECT *, len(ws) AS n, h // 10 AS g FROM words),
cut AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM drawn),
planted AS (
  SELECT doc_id, n, CASE WHEN n > 0 AND h % 10 = 0
    THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE ws END AS ws
  FROM cut
), equal AS (
  SELECT doc_id, q, list_filter(range(n - q), lambda i: ws[i + 1] = ws[i + q + 1]) AS hits
  FROM planted, unnest(range(1, n // 4 + 1)) AS t(q)
), places AS (SELECT doc_id, q, unnest(hits) AS i FROM equal WHERE len(hits) >= 3 * q),
stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM places)
  GROUP BY doc_id, q, island HAVING count(*) >= 3 * q
), runs AS (
  SELECT doc_id, s, e - s AS len, min(q) AS q FROM stretches WHERE e - s >= 6 GROUP BY doc_id, s, e
), best AS (
  SELECT doc_id, count(*) AS n_runs, list({{'l': -len, 's': s, 'q': q}} ORDER BY -len, s, q)[1] AS b,
    string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS body
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(n)) AS i FROM planted) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.l AS length, b.q AS period,
  (-1000 * b.l) // b.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM planted LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# What a kept initial, and an inserted or reroled turn, lead to from each state of the grammar.
STATES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}


def then(cost: int | str, audit: str, line: str, state: int) -> str:
    """A choice: its cost, initial and written lines, and what follows from ``state``."""
    lines = f"[{line}]" if line else "[]::varchar[]"
    return f"{{'c': {cost} + b[{state + 1}].c, 'a': concat('{audit}', b[{state + 1}].a), 'r': list_concat({lines}, b[{state + 1}].r)}}"


def edited(state: int) -> str:
    """Least of deleting, keeping and reroling a row in a state."""
    other = INSERTED[state]
    keeps = " ".join(f"WHEN initial = '{x}' THEN {then('late', 'K', 'concat(role, chr(58), text)', t)}" for x, t in STATES[state].items())
    keep = f"CASE {keeps} END"
    rerole = then("2 + late", "R", f"concat('{ROLE[other]}:', text)", other)
    return f"list_sort(list_filter(CASE WHEN forced THEN [{then(3, 'D', '', state)}] ELSE [{then(3, 'D', '', state)}, {keep}, {rerole}] END, lambda z: z IS NOT NULL))[1]"


def inserted(state: int) -> str:
    """The same with no, one or two turns inserted ahead."""
    found, at, cost, lines, audit = [f"e[{state + 1}]"], state, 0, [], ""
    for _ in range(2):
        at = INSERTED[at]
        cost, audit = cost + 2, audit + "I"
        lines = [*lines, f"'{ROLE[at]}:'"]
        found.append(f"{{'c': {cost} + e[{at + 1}].c, 'a': concat('{audit}', e[{at + 1}].a), 'r': list_concat([{', '.join(lines)}], e[{at + 1}].r)}}")
    return f"list_sort([{', '.join(found)}])[1]"


SPACE = r"\x20\x09-\x0D"
KEY = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"
OP12_SQL = rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(KEY)} % 20 AS f FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE f <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_extract(text, '([^{SPACE}])[{SPACE}]*$', 1) AS ending, left(role, 1) AS initial
  FROM hurt
), faulty AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), rows AS (
  SELECT conv_id, i, role, text, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS forced, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late
  FROM faulty
), walk(conv_id, i, b) AS (
  SELECT conv_id, n, [{{'c': 0, 'a': '', 'r': []::varchar[]}}, {{'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']}},
    {{'c': 2, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0, 'a': '', 'r': []::varchar[]}}]
  FROM counted
  UNION ALL
  SELECT conv_id, i, [{', '.join(inserted(s) for s in range(4))}] FROM (
    SELECT w.conv_id, w.i - 1 AS i, [{', '.join(edited(s) for s in range(4))}] AS e
    FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i)
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b[1].c, 0)::bigint AS cost, coalesce(b[1].a, '') AS audit,
  sha256(coalesce(array_to_string(b[1].r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 0
"""
