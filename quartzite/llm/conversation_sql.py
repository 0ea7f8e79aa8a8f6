"""The repair of conversations in DuckDB SQL: damage, faults, and the least (cost, audit, text) of each state of the pattern, row by row.

The four states are nothing yet, system only, after user, after assistant, as columns s0 to s3; p2 and p3 are those that inserts before
the next row also reach. A struct's order is that of cost, then audit.
"""

from __future__ import annotations

USER, ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"


def _edit(state: str, cost: str, letters: str, line: str = "''", where: str = "true") -> str:
    cost = f"CASE WHEN {where} THEN {state}.c + {cost} ELSE 1000000000000 END"
    return f"{{'c': {cost}, 'a': {state}.a || '{letters}', 't': {state}.t || {line}}}"


def _least(*found: str) -> str:
    return f"list_min([{', '.join(found)}])"


def _delete(state: str) -> str:
    return _edit(state, "2", "D")


def _keep(state: str, letter: str) -> str:
    return _edit(state, "extra", "K", "chr(10) || role || ':' || text", f"stay AND letter = '{letter}'")


def _rerole(state: str, role: str) -> str:
    return _edit(state, "1 + extra", "R", f"chr(10) || '{role}:' || text", "stay")


_BEFORE_USER = ("p0", "p1", "p3")
P2 = _least("s2", *[_edit(s, "5", "I", USER) for s in ("s0", "s1", "s3")])
P3 = _least("s3", _edit("s2", "5", "I", ASSISTANT), *[_edit(s, "10", "II", f"{USER} || {ASSISTANT}") for s in ("s0", "s1")])
N0 = _delete("p0")
N1 = _least(_delete("p1"), _keep("p0", "s"))
N2 = _least(_delete("p2"), *[_rerole(s, "user") for s in _BEFORE_USER], *[_keep(s, "u") for s in _BEFORE_USER])
N3 = _least(_delete("p3"), _rerole("p2", "assistant"), _keep("p2", "a"))
END = _least("s0", "s3", _edit("s2", "5", "I", ASSISTANT), _edit("s1", "10", "II", f"{USER} || {ASSISTANT}"))
FIRST, NONE = "{'c': 0::BIGINT, 'a': '', 't': ''}", "{'c': 1000000000000, 'a': '', 't': ''}"

SQL = f"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM keyed, crc),
    damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS core, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS letter FROM placed),
    flagged AS (SELECT conv_id, turn, role, text, k, letter, core = '' AS blank, core <> '' AND again AS dup, core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS cut,
      CASE WHEN k > 1 AND lag(letter) OVER (PARTITION BY conv_id ORDER BY k) || letter NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad FROM seen),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, sum(bad) AS illegal, count(*) AS n FROM flagged GROUP BY conv_id),
    steps AS (SELECT conv_id, k, role, text, letter, NOT (blank OR dup) AS stay, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM flagged),
    walk AS (
      SELECT conv_id, 0::BIGINT AS k, {FIRST} AS s0, {NONE} AS s1, {NONE} AS s2, {NONE} AS s3 FROM counts
      UNION ALL
      SELECT conv_id, k, {N0}, {N1}, {N2}, {N3} FROM (
        SELECT w.conv_id, s.k, s.role, s.text, s.letter, s.stay, s.extra, s0 AS p0, s1 AS p1, {P2} AS p2, {P3} AS p3
        FROM walk w JOIN steps s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.k = w.k + 1) x),
    ended AS (SELECT w.conv_id, {END} AS best FROM walk w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.k = c.n)
    SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
      coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON i.conv_id IS NOT DISTINCT FROM e.conv_id
"""
