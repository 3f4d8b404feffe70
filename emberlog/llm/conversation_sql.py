"""DuckDB SQL for the rows of the two conversation queries."""

from __future__ import annotations

#: CRC-32 of an ASCII string, bit by bit.
_CRC = """CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: 0::BIGINT)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) AS BIGINT)"""

OP11_SQL = (
    """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS o,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT c, c - c % 20 AS base, """ + _CRC.format("c::VARCHAR") + r""" % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT b.c, t.o, 0 AS own, role, text FROM b JOIN t ON t.c = b.base AND t.o <= b.h UNION ALL SELECT b.c, t.o, 1, role, text FROM b JOIN t ON t.c = b.c AND t.o > b.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, o) AS d, role, text FROM r),
k AS (SELECT c, d, text, string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM d),
paths AS (SELECT c, d, sha256(path) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM k UNION ALL SELECT c, 0, 'root', 0 FROM b),
nodes AS (SELECT node, d, min(c) AS c, count(*) AS n, max(words) AS words FROM paths GROUP BY node, d),
up AS (SELECT DISTINCT p.node, q.node AS above FROM paths p JOIN paths q ON p.c = q.c AND p.d = q.d + 1),
kids AS (SELECT above AS node, count(*) AS n_children FROM up GROUP BY 1),
under AS (SELECT DISTINCT q.node, p.node AS low FROM paths p JOIN paths q ON p.c = q.c AND p.d >= q.d),
sums AS (SELECT u.node, count(*) FILTER (kids.node IS NULL) AS n_leaves, sum((nodes.n - 1) * nodes.words)::BIGINT AS saved_tokens FROM under u JOIN nodes ON nodes.node = u.low LEFT JOIN kids ON kids.node = u.low GROUP BY 1),
last AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
ends AS (SELECT p.node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM paths p JOIN last USING (c, d) GROUP BY 1)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, a.c AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN up ON up.node = n.node LEFT JOIN nodes a ON a.node = up.above LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.node = n.node LEFT JOIN ends ON ends.node = n.node
"""
)

#: Best cost (nine digits) and letters from a state on, as one string, so that the least string is the answer.
_BAD = "'999999999'"


def _put(letter: str, cost: str, value: str) -> str:
    return f"CASE WHEN {value} < {_BAD} THEN lpad((substr({value}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({value}, 10) ELSE {_BAD} END"


def _inserts(names: str = "g0, g1, g2, g3") -> str:
    """Up to two inserted turns before what follows."""
    g = names.split(", ")
    first = [f"least({g[s]}, {_put('I', '3', g[n])})" for s, n in enumerate((2, 2, 3, 2))]
    return f"(SELECT {', '.join(f'least({c}, {_put("I", "3", f"f{n}")}) AS v{s}' for s, (c, n) in enumerate(zip(('f0', 'f1', 'f2', 'f3'), (2, 2, 3, 2))))} FROM (SELECT {', '.join(f'{f} AS f{s}' for s, f in enumerate(first))}))"


def _step(state: int) -> str:
    following = (2, 2, 3, 2)[state]
    to = "'u'" if following == 2 else "'a'"
    keep = f"CASE WHEN NOT stay THEN {_BAD} WHEN i = {to} THEN {_put('K', 'more', f'v{following}')}" + (f" WHEN i = 's' THEN {_put('K', 'more', 'v1')}" if state == 0 else "") + f" ELSE {_BAD} END"
    rename = f"CASE WHEN stay THEN {_put('R', '3 + more', f'v{following}')} ELSE {_BAD} END"
    return f"least({_put('D', '4', f'v{state}')}, {keep}, {rename}) AS g{state}"


OP12_SQL = (
    """
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, """ + _CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')") + r""" % 20 AS k FROM conversations),
ids AS (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM raw)),
dam AS (SELECT id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM raw JOIN ids ON raw.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE k > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), again) AS n FROM dam),
m AS (SELECT *, substr(role, 1, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY id, role, text ORDER BY n) > 1 AS dup, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
  lag(substr(role, 1, 1)) OVER (PARTITION BY id ORDER BY n) AS before FROM o),
f AS (SELECT *, NOT blank AND NOT dup AS stay, CASE WHEN cut AND NOT blank AND NOT dup THEN 3 ELSE 0 END AS more FROM m),
total AS (SELECT ids.id, conv_id, count(n) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup AND NOT blank) AS duplicate,
  count(*) FILTER (more > 0) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM ids LEFT JOIN f ON f.id = ids.id GROUP BY ALL),
dp AS (SELECT id, n_rows AS n, e.* FROM total, LATERAL """ + _inserts("'000000000', '999999999', '999999999', '000000000'") + """ e
  UNION ALL SELECT s.id, s.n - 1, e.* FROM (SELECT dp.id, dp.n, """ + ", ".join(map(_step, range(4))) + """ FROM dp JOIN f ON f.id = dp.id AND f.n = dp.n) s, LATERAL """ + _inserts() + """ e),
best AS (SELECT id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM dp WHERE n = 0),
l AS (SELECT id, unnest(range(1, length(audit) + 1)) AS p, audit FROM best),
e AS (SELECT id, p, substr(audit, p, 1) AS letter, p - length(replace(substr(audit, 1, p), 'I', '')) AS ins, audit FROM l),
x AS (SELECT e.id, p, letter, role, text, i, row_number() OVER (PARTITION BY e.id ORDER BY p) AS q FROM e LEFT JOIN f ON f.id = e.id AND f.n = e.p - e.ins AND letter <> 'I' WHERE letter <> 'D'),
y AS (SELECT *, coalesce(max(CASE WHEN q = 1 AND letter = 'K' AND i = 's' THEN 1 END) OVER (PARTITION BY id), 0) AS sys FROM x),
z AS (SELECT id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (q - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY q)) AS sha FROM y GROUP BY id)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, coalesce(sha, sha256('')) AS repaired_sha256 FROM total JOIN best USING (id) LEFT JOIN z USING (id)
"""
)
