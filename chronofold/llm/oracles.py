"""SQL for DuckDB for those corpus queries that SQL can express."""

from __future__ import annotations

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOW}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
SPACED = rf"regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+')"

#: Pairs by shared shingles, then everything that is reachable over links.
NEARDUP = f"""WITH RECURSIVE d AS (SELECT doc_id, {SPACED} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents), b AS (SELECT item_id, {ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, list_slice(w, k, k + 9) AS v FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
q AS (SELECT DISTINCT item_id, len(v) AS n, array_to_string(v, ' ') AS g FROM bw),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
h AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN q ON q.n = dw.n AND q.g = dw.g),
hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS pos FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM h) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id"""


def escaped(x: str) -> str:
    return f"length(replace(replace({x}, '\\', '\\\\'), '<|', '<\\|'))"


SAID = "<|im_end|><|im_start|>assistant ok"
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-1, 0, 'user', '{SAID}'), (-1, 1, 'assistant', '{SAID}'))
SELECT cast(conv_id AS bigint) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
cast(sum(24 + {escaped("role")} + {escaped("text")}) AS bigint) AS formatted_chars FROM c GROUP BY 1"""

RANKED = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {ALNUM} AS w FROM documents),
c AS (SELECT row, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0), g AS (SELECT count(*) AS big_n, cast(sum(n) AS bigint) AS big_l FROM c),
q AS (SELECT DISTINCT item_id, unnest({ALNUM}) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM c) GROUP BY ALL),
v AS (SELECT term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS bigint) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), g),
s AS (SELECT item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS bigint) AS score
  FROM q JOIN p USING (term) JOIN v USING (term), g GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

#: The reflected polynomial of CRC-32, eight shifts for each byte of the decimal number.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id AS varchar), ''), lambda ch: cast(ord(ch) AS bigint))),
lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
TRIE = f"""WITH o AS (SELECT conv_id, n, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS k FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n,
  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, ({CRC}) % 6 AS h, coalesce((SELECT max(k) FROM o WHERE o.conv_id = x.conv_id - x.conv_id % 100), 0) AS has FROM (SELECT DISTINCT conv_id FROM o) x),
r AS (SELECT c.conv_id, o.k AS depth, t, n FROM c JOIN o ON o.conv_id = c.base AND o.k <= c.h
  UNION ALL SELECT c.conv_id, least(c.h, c.has) + o.k - c.h, t, n FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h),
s AS (SELECT c.conv_id, coalesce(any_value(l.ts), []) AS ts, coalesce(any_value(l.ns), []) AS ns FROM c LEFT JOIN (SELECT conv_id, list(t ORDER BY depth) AS ts, list(n ORDER BY depth) AS ns FROM r GROUP BY 1) l ON l.conv_id = c.conv_id GROUP BY 1),
p AS (SELECT conv_id, len(ts) AS size, d, array_to_string(list_slice(ts, 1, d), '') AS prefix, coalesce(ns[d], 0) AS n FROM (SELECT *, unnest(generate_series(0, len(ts))) AS d FROM s)),
m AS (SELECT d, prefix, left(prefix, greatest(d - 1, 0) * 64) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT d - 1 AS d, up AS prefix, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT m.*, coalesce(n_children, 0) AS n_children, (m.n_convs - 1) * m.n AS saved FROM m LEFT JOIN k USING (d, prefix)),
b AS (SELECT a AS d, left(prefix, a * 64) AS prefix, cast(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS bigint) AS n_leaves, cast(sum(saved) AS bigint) AS saved_tokens FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM v) GROUP BY 1, 2)
SELECT v.conv_id, cast(v.d AS bigint) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens, v.ends_sha256
FROM v JOIN b ON b.d = v.d AND b.prefix = v.prefix LEFT JOIN v u ON v.d > 0 AND u.d = v.d - 1 AND u.prefix = v.up"""

ORACLES = {"op4_neardup": NEARDUP, "op6_decontaminate": DECONTAMINATE, "op10_templates": CHAT, "op12_hybridrank": RANKED, "op13_prefixtrie": TRIE}
