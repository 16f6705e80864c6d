"""DuckDB SQL of the operators on conversations and benchmarks."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""
WITH iw AS (SELECT item_id, {_NORMAL} AS ws FROM benchmark),
ik AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k
       FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
dw AS (SELECT doc_id, {_NORMAL} AS ws FROM documents),
dk AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM ik) WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dk JOIN ik USING (n, k)),
w AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)
"""

# the checksum, bit by bit over the bytes of an ASCII string
_CRC = """xor(list_reduce(flatten(list_transform(string_split({key}, ''), lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295)"""

# a way to go on is {c: cost, a: audit, t: repaired lines}; the least one is the cheapest, ties to the least audit
_NEVER = "{'c': 1000000, 'a': '', 't': ''}"


def _way(rest: str, cost: str, edit: str, line: str = "''") -> str:
    return f"{{'c': ({rest}).c + {cost}, 'a': '{edit}' || ({rest}).a, 't': {line} || ({rest}).t}}"


def _own(state: str, role: str, to: str) -> str:
    """Cheapest use of the row x in a grammar state that may write ``role``, before inserts."""
    extra = "(CASE WHEN x.f = 'truncated' THEN 3 ELSE 0 END)"
    kept = "x.role || ':' || x.text || chr(10)"
    ways = [_way(f"z.{state}", "4", "D")]
    ways.append(f"CASE WHEN x.f IN ('blank', 'duplicate') THEN {_NEVER} ELSE {_way(f'z.{to}', f'3 + {extra}', 'R', f'''{chr(39)}{role}:{chr(39)} || x.text || chr(10)''')} END")
    ways.append(f"CASE WHEN x.f IN ('blank', 'duplicate') OR x.i <> '{role[0]}' THEN {_NEVER} ELSE {_way(f'z.{to}', extra, 'K', kept)} END")
    if state == "none":
        ways.append(f"CASE WHEN x.f IN ('blank', 'duplicate') OR x.i <> 's' THEN {_NEVER} ELSE {_way('z.sys', extra, 'K', kept)} END")
    return f"least({', '.join(ways)})"


def _insert(rest: str, role: str) -> str:
    return _way(rest, "3", "I", f"'{role}:' || chr(10)")


_OWN = f"{{'none': {_own('none', 'user', 'usr')}, 'sys': {_own('sys', 'user', 'usr')}, 'usr': {_own('usr', 'assistant', 'pair')}, 'pair': {_own('pair', 'user', 'usr')}}}"
_TWO = f"{{'none': o.none, 'sys': o.sys, 'usr': least(o.usr, {_insert('o.pair', 'assistant')}), 'pair': least(o.pair, {_insert('o.usr', 'user')})}}"
_ALL = f"{{'none': least(o.none, {_insert('o.usr', 'user')}), 'sys': least(o.sys, {_insert('o.usr', 'user')}), 'usr': o.usr, 'pair': o.pair}}"
_STEP = f"list_transform(list_transform([{_OWN}], lambda o: {_TWO}), lambda o: {_ALL})[1]"
_EMPTY = "{'c': 0, 'a': '', 't': ''}"
_END = f"list_transform([{{'none': {_EMPTY}, 'usr': {_insert(_EMPTY, 'assistant')}, 'pair': {_EMPTY}}}], lambda o: {{'none': o.none, 'sys': {_insert('o.usr', 'user')}, 'usr': o.usr, 'pair': o.pair}})[1]"

OP11_SQL = f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
q AS (SELECT *, {_CRC.format(key="key")} % 20 AS kind FROM k),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
      FROM q WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM r),
f AS (SELECT *, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS b,
             rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen FROM p),
g AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
             count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (b || i NOT IN ('su', 'ua', 'au')) AS illegal,
             list({{'role': role, 'text': text, 'i': i, 'f': f}} ORDER BY pos DESC) AS rows FROM g GROUP BY conv_id),
d AS (SELECT *, list_reduce(rows, lambda z, x: {_STEP}, {_END}).none AS best FROM c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
