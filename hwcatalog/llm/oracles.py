"""DuckDB SQL for the log, trie and shard operators, by other means than theirs."""

from __future__ import annotations

from .sharding import SPREAD, Permutation


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, half a byte at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    half = lambda c: f"xor({c} >> 4, {table}[({c} & 15) + 1])"
    hexes = "'0123456789ABCDEF'"
    byte = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: 16 * instr({hexes}, x[1]) + instr({hexes}, x[2]) - 17)"
    return f"xor(4294967295::BIGINT, list_reduce({byte}, lambda c, b: {half(half('xor(c, b)'))}, 4294967295::BIGINT))"


#: Each change's later open rollbacks are counted by window sums; versions are laid over each other key by key.
OP11 = f"""WITH h AS (SELECT doc_id, coalesce(concat('s', source), '') AS s, text, {crc32("doc_id::VARCHAR")} AS h FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT *, CASE WHEN h % 23 < 2 THEN 'commit' WHEN h % 23 < 3 THEN 'abort' WHEN h % 23 < 5 THEN 'save' WHEN h % 23 < 7 THEN 'rollback' ELSE 'change' END AS kind, h // 100 % 300 AS k FROM h),
t AS (SELECT *, min(doc_id) FILTER (kind IN ('commit', 'abort')) OVER (PARTITION BY s ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fin FROM l),
e AS (SELECT doc_id AS fin, kind AS how, (row_number() OVER (PARTITION BY kind ORDER BY doc_id) + 3) // 4 AS epoch FROM l WHERE kind IN ('commit', 'abort')),
c AS (SELECT *, sum(CASE kind WHEN 'rollback' THEN 1 WHEN 'save' THEN -1 ELSE 0 END) OVER (PARTITION BY s, fin ORDER BY doc_id DESC) AS n FROM t),
d AS (SELECT *, n - least(0, min(n) OVER (PARTITION BY s, fin ORDER BY doc_id DESC)) AS level FROM c),
u AS (SELECT *, min(doc_id) FILTER (kind = 'rollback') OVER (PARTITION BY s, fin, level ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS undo FROM d),
f AS (SELECT u.*, how, epoch FROM u LEFT JOIN e ON e.fin = u.fin WHERE kind = 'change'),
v AS (SELECT k, epoch, fin, f.doc_id, CASE WHEN text IS NOT NULL AND f.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN {crc32("concat(k, ':', text)")} END AS v FROM f WHERE level = 0 AND how = 'commit'),
w AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY fin, doc_id) AS was FROM v),
x AS (SELECT epoch, sum((v IS NOT NULL)::INT - (was IS NOT NULL)::INT) AS dn, sum(coalesce(v, 0) - coalesce(was, 0)) AS dv FROM w GROUP BY epoch),
y AS (SELECT DISTINCT epoch FROM e WHERE how = 'commit')
SELECT 'state' AS kind, epoch::BIGINT AS id, (sum(coalesce(dn, 0)) OVER (ORDER BY epoch))::BIGINT AS n, (sum(coalesce(dv, 0)) OVER (ORDER BY epoch))::BIGINT AS value FROM y LEFT JOIN x USING (epoch)
UNION ALL SELECT CASE WHEN level > 0 THEN 'rollback' ELSE 'abort' END, doc_id, CASE WHEN level > 0 THEN undo ELSE fin END, k::BIGINT FROM f WHERE level > 0 OR how IS DISTINCT FROM 'commit'"""

#: Every conversation's prefixes as texts; a node's subtree by the prefixes of the conversation that names each node.
OP12 = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i <= h UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, sha256(concat(length(role), ' ', role, text)) AS x, length(text) AS n FROM r),
p AS (SELECT conv_id, depth, n, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, coalesce(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up FROM o),
q AS (SELECT * FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
g AS (SELECT key, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS m, any_value(n) AS n FROM q GROUP BY key),
k AS (SELECT up AS key, count(*) AS kids FROM g GROUP BY up),
j AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN k USING (key)),
s AS (SELECT q.key, sum((kids = 0)::INT) AS leaves, sum((m - 1) * j.n) AS saved FROM j JOIN q ON q.conv_id = j.conv_id AND q.depth <= j.depth GROUP BY q.key),
z AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(key, depth) AS key FROM q GROUP BY conv_id) GROUP BY key)
SELECT j.conv_id, j.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, j.m AS n_convs, j.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM j LEFT JOIN g a ON a.key = j.up JOIN s ON s.key = j.key LEFT JOIN z ON z.key = j.key"""


def _rounds() -> str:
    """SQL for one pass of (l, r) through the network: (l, r) of a row x of a table with a and b."""
    keys, wrap = Permutation(1).keys.tolist(), 2**64
    out = "SELECT row, n, a, b, v // b AS l, v % b AS r FROM {0}"
    for i, (k, c) in enumerate(keys):
        side, other, size = ("r", "l", "b") if i % 2 else ("l", "r", "a")
        out = f"SELECT row, n, a, b, {other}, ({side} + (((xor(x, x >> 32))::HUGEINT * {SPREAD} % {wrap})::UBIGINT >> 33)::HUGEINT) % {size} AS {side} FROM (SELECT *, (({other} * {k} + {c}) % {wrap})::UBIGINT AS x FROM ({out}))"
    return f"SELECT row, n, a, b, l * b + r AS v FROM ({out})"


#: The network again, in integers of 128 bits; whoever is at n or above walks on.
OP13 = f"""WITH RECURSIVE d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32("coalesce(text, '')")} AS crc FROM documents),
o AS (SELECT *, (row_number() OVER (ORDER BY doc_id NULLS LAST, crc, size) - 1)::HUGEINT AS row, (count(*) OVER ())::HUGEINT AS n FROM d),
m AS (SELECT row, n, row AS v, (floor(sqrt((n - 1)::DOUBLE)) + 1)::HUGEINT AS a FROM o),
w AS (SELECT *, 0 AS turn FROM ({_rounds().format("(SELECT *, (n + a - 1) // a AS b FROM m)")}) UNION ALL SELECT *, 1 FROM ({_rounds().format("(SELECT * FROM w WHERE v >= n)")}))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (v % 8)::INT AS shard, (v // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM o JOIN w USING (row) WHERE v < w.n"""
