"""SQL for DuckDB that states the registered queries' answers on the same tables."""

from __future__ import annotations

from chronofold.functions.text import CODE_EXTENSIONS
from chronofold.sources import fixtures as fx


def T(share: float) -> str:
    return f"(SELECT cast(floor(min(s) + (max(s) - min(s)) * {share}) AS bigint) FROM (SELECT cast(floor(epoch(ts)) AS bigint) AS s FROM events))"


#: Common table expressions that oracles name. Every content of the fixture is one line, so a merge of texts gives the
#: later one, and in code each merge wraps the content so far: st_ states both in SQL.
FOLD = """
r_{x} AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY lamport, site_id, id) AS rn FROM {x} WHERE kind NOT IN ('merge','branch','tag')),
c_{x} AS (SELECT *, max(CASE WHEN kind = 'create' THEN rn END) OVER (PARTITION BY file_id) AS cr FROM r_{x}),
d_{x} AS (SELECT *, min(CASE WHEN kind = 'delete' THEN rn END) OVER (PARTITION BY file_id) AS dr FROM c_{x} WHERE rn >= cr),
k_{x} AS (SELECT * FROM d_{x} WHERE dr IS NULL OR rn <= dr OR kind = 'delete'),
l_{x} AS (SELECT *, lag(result_hash) OVER (PARTITION BY file_id ORDER BY rn) AS prev FROM k_{x} WHERE kind IN ('create','edit')),
ln_{x} AS (SELECT file_id, arg_max(path, rn) FILTER (WHERE kind IN ('create','rename')) AS path,
  arg_max(result_hash, rn) FILTER (WHERE kind IN ('create','edit')) AS result_hash,
  arg_max(merge_class, rn) FILTER (WHERE kind IN ('create','reclass')) AS merge_class, bool_or(kind = 'delete') AS deleted,
  arg_max(lamport, rn) AS lamport, arg_max(site_id, rn) AS site_id,
  max(rn) FILTER (WHERE kind IN ('create','rename')) AS crn,
  arg_max({{'lamport': lamport, 'site_id': site_id, 'id': id}}, rn) FILTER (WHERE kind IN ('create','rename')) AS claim,
  bool_or(EXISTS (SELECT 1 FROM l_{x} l WHERE l.id = k.id AND l.file_id = k.file_id AND l.kind = 'edit' AND l.base_hash IS DISTINCT FROM l.prev)) AS needs_merge
  FROM k_{x} k GROUP BY file_id),
e_{x} AS (SELECT *, last_value(CASE WHEN kind IN ('create','reclass') THEN merge_class END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cls,
  regexp_extract(file_id, '[0-9]+$') || ':' || substr(id, 2) AS txt FROM k_{x}),
f_{x} AS (SELECT e.*, e.kind = 'edit' AND e.base_hash IS DISTINCT FROM l.prev AS stale FROM e_{x} e JOIN l_{x} l ON l.id = e.id AND l.file_id = e.file_id),
m_{x} AS (SELECT *, min(CASE WHEN stale AND cls = 'code' THEN rn END) OVER (PARTITION BY file_id) AS fm FROM f_{x}),
n_{x} AS (SELECT file_id, bool_or(stale) AS conflict, min(fm) AS fm, arg_max(stale, rn) AS laststale, arg_max(txt, rn) AS lasttxt, arg_max(txt, rn) FILTER (rn < fm) AS c0, count(*) FILTER (rn >= fm) AS n,
  string_agg('=======' || chr(10) || txt || chr(10) || '>>>>>>> B' || chr(10), '' ORDER BY rn) FILTER (rn >= fm) AS tail FROM m_{x} GROUP BY file_id),
c2_{x} AS (SELECT *, CASE WHEN fm IS NULL THEN lasttxt ELSE repeat('<<<<<<< A' || chr(10), n) || c0 || chr(10) || tail END AS content FROM n_{x}),
st_{x} AS (SELECT s.* EXCLUDE (result_hash), CASE WHEN fm IS NULL THEN s.result_hash ELSE sha256(content) END AS result_hash, coalesce(conflict, false) AS conflict, content, fm IS NOT NULL OR laststale AS made FROM ln_{x} s LEFT JOIN c2_{x} c ON c.file_id = s.file_id),
p_{x} AS (SELECT *, CASE WHEN deleted THEN 1 ELSE row_number() OVER (PARTITION BY deleted, path ORDER BY claim.lamport, claim.site_id, claim.id, file_id) END AS k FROM st_{x}),
res_{x} AS (SELECT file_id, CASE WHEN k = 1 THEN path ELSE concat(regexp_replace(path, '\\.[^./]*$', ''), ' (', k - 1, ')', regexp_extract(path, '\\.[^./]*$')) END AS path,
  CASE WHEN deleted THEN NULL ELSE result_hash END AS result_hash, merge_class, deleted, lamport, site_id, conflict, content FROM p_{x})
""".replace("{{", "«").replace("}}", "»")

#: Places by clock, but parents before their children: the smallest row whose parent is placed or unknown comes next.
CAUSAL = """
w_{x} AS (SELECT * FROM {x} WHERE kind NOT IN ('merge','branch','tag')),
o_{x} AS (SELECT DISTINCT file_id, []::varchar[] AS done, 0 AS rn, '' AS id FROM w_{x}
  UNION ALL SELECT file_id, list_append(done, nid), rn + 1, nid FROM (SELECT o.file_id, o.done, o.rn, arg_min(r.id, {{'l': r.lamport, 's': r.site_id, 'i': r.id}}) AS nid
  FROM o_{x} o JOIN (SELECT a.*, b.id IS NOT NULL AS bound FROM w_{x} a LEFT JOIN w_{x} b ON b.id = a.parent AND b.file_id = a.file_id) r
    ON r.file_id = o.file_id AND NOT list_contains(o.done, r.id) AND (NOT r.bound OR list_contains(o.done, r.parent)) GROUP BY o.file_id, o.done, o.rn)),
r_{x} AS (SELECT w.*, o.rn FROM w_{x} w JOIN o_{x} o ON o.file_id = w.file_id AND o.id = w.id),""".replace("{{", "«").replace("}}", "»")

#: The states of a table after every row, through all lives of a file; contents as in FOLD.
LIVES = """
a_{x} AS (SELECT * FROM (SELECT *, count(*) FILTER (kind = 'create') OVER (PARTITION BY file_id ORDER BY rn) AS life FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY lamport, site_id, id) AS rn FROM {x} WHERE kind NOT IN ('merge','branch','tag'))) WHERE life > 0),
b_{x} AS (SELECT * FROM (SELECT *, min(CASE WHEN kind = 'delete' THEN rn END) OVER (PARTITION BY file_id, life) AS dr FROM a_{x}) WHERE dr IS NULL OR rn <= dr OR kind = 'delete'),
t_{x} AS (SELECT *, last_value(CASE WHEN kind IN ('create','reclass') THEN merge_class END IGNORE NULLS) OVER (PARTITION BY file_id, life ORDER BY rn) AS cls, regexp_extract(file_id, '[0-9]+$') || ':' || substr(id, 2) AS txt FROM b_{x}),
u_{x} AS (SELECT t.*, t.kind = 'edit' AND t.base_hash IS DISTINCT FROM l.prev AS stale FROM t_{x} t LEFT JOIN (SELECT file_id, id, lag(result_hash) OVER (PARTITION BY file_id, life ORDER BY rn) AS prev FROM b_{x} WHERE kind IN ('create','edit')) l ON l.id = t.id AND l.file_id = t.file_id),
g_{x} AS (SELECT *, kind IN ('create','edit') AS has, min(CASE WHEN stale AND cls = 'code' THEN rn END) OVER (PARTITION BY file_id, life) AS fm FROM u_{x}),
h_{x} AS (SELECT *, max(CASE WHEN has AND rn < fm THEN rn END) OVER (PARTITION BY file_id, life) AS r0, max(CASE WHEN has THEN rn END) OVER (PARTITION BY file_id, life ORDER BY rn) AS at FROM g_{x}),
i_{x} AS (SELECT h.*, c.result_hash AS ch, c.stale AS cs, z.txt AS c0 FROM h_{x} h JOIN h_{x} c ON c.file_id = h.file_id AND c.rn = h.at LEFT JOIN h_{x} z ON z.file_id = h.file_id AND z.rn = h.r0),
j_{x} AS (SELECT *, count(*) FILTER (has AND rn >= fm) OVER w AS n, string_agg(CASE WHEN has AND rn >= fm THEN '=======' || chr(10) || txt || chr(10) || '>>>>>>> B' || chr(10) ELSE '' END, '') OVER w AS tail,
  last_value(CASE WHEN kind IN ('create','rename') THEN path END IGNORE NULLS) OVER w AS p, coalesce(bool_or(kind = 'delete') OVER w, false) AS gone FROM i_{x} WINDOW w AS (PARTITION BY file_id, life ORDER BY rn)),
q_{x} AS (SELECT file_id, rn, ts, p AS path, CASE WHEN n > 0 THEN sha256(repeat('<<<<<<< A' || chr(10), n) || c0 || chr(10) || tail) ELSE ch END AS result_hash, gone AS deleted,
  CASE WHEN n > 0 THEN repeat('<<<<<<< A' || chr(10), n) || c0 || chr(10) || tail END AS content FROM j_{x}),
v_{x} AS (SELECT file_id, result_hash, path, deleted, content, ts AS valid_from, lead(ts) OVER (PARTITION BY file_id ORDER BY rn) AS valid_to FROM (SELECT *, lag({{'a': coalesce(result_hash, ''), 'b': coalesce(path, ''), 'c': deleted}}) OVER (PARTITION BY file_id ORDER BY rn) IS DISTINCT FROM {{'a': coalesce(result_hash, ''), 'b': coalesce(path, ''), 'c': deleted}} AS fresh FROM q_{x}) WHERE fresh)
""".replace("{{", "«").replace("}}", "»")

SIMPLE = {
    "log": fx.portable(fx.LOG, False),
    "lin": fx.portable(fx.LINEAR_LOG, False),
    "blobs": fx.portable(fx.BLOBS, False),
    "meta": fx.portable(fx.META, False),
    "branches": fx.portable(fx.BRANCHES, False),
}


def oracle(sql: str, *names: str, fold: tuple[str, ...] = (), causal: tuple[str, ...] = (), lives: tuple[str, ...] = (), **more: str) -> str:
    """sql behind the named common tables, then `more` ones, then the fold of the tables in `fold` (in `causal`: by causal order)."""
    parts = [f"{n} AS ({SIMPLE[n]})" for n in names] + [f"{n} AS ({s})" for n, s in more.items()]
    by_key = FOLD.strip().split("\n", 1)
    parts += [(FOLD if x in fold else CAUSAL + by_key[1]).replace("{x}", x).replace("«", "{").replace("»", "}") for x in (*fold, *causal)]
    parts += [LIVES.replace("{x}", x).replace("«", "{").replace("»", "}") for x in lives]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql


OLD = """SELECT CASE WHEN doc_id % 9 = 0 THEN source || '/d' || doc_id || '.log' ELSE source || '/d' || doc_id || '.md' END AS path, sha256(text) AS h, strlen(text) AS size
FROM documents WHERE doc_id % 7 <> 0"""
NEW = """SELECT CASE WHEN doc_id % 5 = 0 THEN 'moved/' ELSE '' END || source || '/d' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.log' ELSE '.md' END AS path,
CASE WHEN doc_id % 6 = 1 THEN sha256(sha256(text) || 'x') ELSE sha256(text) END AS h, strlen(text) AS size FROM documents WHERE doc_id % 11 <> 0"""
RENAMES = """SELECT g.path AS old_path, c.path AS new_path FROM
(SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM {old} WHERE size > 8 AND path NOT IN (SELECT path FROM {new})) g JOIN
(SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM {new} WHERE size > 8 AND path NOT IN (SELECT path FROM {old})) c ON g.h = c.h AND g.k = c.k"""
PATHS = "SELECT page_id, regexp_replace(regexp_extract(url, '//([^?#]+)', 1), '^(www|m|blog)\\.', 'build/') AS path, length(html) AS size FROM pages"

KEY = "{'l': lamport, 's': site_id, 'i': id}"
LINEAGE = """SELECT branch_id AS target, 0 AS depth, branch_id, parent, [branch_id] AS seen FROM {b}
UNION ALL SELECT l.target, l.depth + 1, b.branch_id, b.parent, list_append(l.seen, b.branch_id) FROM lines l JOIN {b} b ON b.branch_id = l.parent WHERE NOT list_contains(l.seen, b.branch_id)"""
ALL_BRANCHES = "SELECT branch_id, parent, cap, created_lamport FROM branches UNION ALL SELECT 'main', NULL, NULL, 0"
#: Fork vectors here bound all five sites alike, so the cap of an ancestor is the least of the nearer branches' bounds.
VISIBLE = """SELECT l.target, x.* FROM log x JOIN lines l ON x.branch_id = l.branch_id WHERE l.depth = 0 OR
x.seq <= (SELECT min(b.cap) FROM lines g JOIN allb b ON b.branch_id = g.branch_id WHERE g.target = l.target AND g.depth < l.depth AND l.depth =
(SELECT count(b2.cap) FROM lines g2 JOIN allb b2 ON b2.branch_id = g2.branch_id WHERE g2.target = l.target AND g2.depth < l.depth))"""
VIS = {"allb": ALL_BRANCHES, "lines": LINEAGE.replace("{b}", "allb"), "vis": VISIBLE}
BREC = """SELECT id, lamport, site_id, file_id, json_extract_string(record, '$.branch_id') AS branch_id, json_extract_string(record, '$.name') AS name,
json_extract_string(record, '$.parent') AS parent, cast(json_extract_string(record, '$.created_lamport') AS bigint) AS created_lamport,
cast(json_extract_string(record, '$.fork_vv.s0') AS bigint) AS s0, cast(json_extract_string(record, '$.fork_vv.s1') AS bigint) AS s1, cast(json_extract_string(record, '$.deleted') AS boolean) AS deleted FROM meta WHERE kind = 'branch' AND record LIKE '{%'"""
BLWW = f"SELECT unnest(r) FROM (SELECT arg_max({{'branch_id': branch_id, 'name': name, 'parent': parent, 'created_lamport': created_lamport, 'deleted': deleted, 's0': s0, 's1': s1}}, {KEY}) AS r FROM brec GROUP BY file_id)"
TREC = """SELECT id, lamport, site_id, file_id, json_extract_string(record, '$.tag_id') AS tag_id, json_extract_string(record, '$.name') AS name,
cast(json_extract_string(record, '$.at_ts') AS bigint) AS at_ts, json_extract_string(record, '$.branch_id') AS branch_id FROM meta WHERE kind = 'tag' AND record LIKE '{%'"""
TLWW = f"SELECT unnest(r) FROM (SELECT arg_max({{'tag_id': tag_id, 'name': name, 'at_ts': at_ts, 'branch_id': branch_id}}, {KEY}) AS r FROM trec GROUP BY file_id)"
REC = {"brec": BREC, "bl": BLWW, "trec": TREC, "tl": TLWW}
BMAIN = "SELECT branch_id, parent, deleted, created_lamport FROM bl UNION ALL SELECT 'main', NULL, false, 0"

GRAPH = {
    "lanes": "SELECT branch_id, row_number() OVER (ORDER BY branch_id <> 'main', created_lamport, branch_id) - 1 AS lane, parent, greatest(created_lamport, coalesce(cap, 0)) AS fork FROM allb",
    "g1": "SELECT *, CASE WHEN lag(site_id) OVER w IS NULL OR lag(site_id) OVER w <> site_id OR lamport - lag(lamport) OVER w > 3 THEN 1 ELSE 0 END AS s FROM log WHERE kind <> 'branch' WINDOW w AS (PARTITION BY branch_id ORDER BY lamport, site_id, id)",
    "g2": "SELECT *, sum(s) OVER (PARTITION BY branch_id ORDER BY lamport, site_id, id) AS c FROM g1",
    "commits": f"SELECT branch_id, c, arg_max(id, {KEY}) AS commit_id, arg_max(ts, {KEY}) AS ts, max(lamport) AS lamport, count(*) AS n, arg_max(path, {KEY}) FILTER (WHERE path IS NOT NULL) AS p FROM g2 GROUP BY branch_id, c",
    "labelled": "SELECT *, CASE WHEN p IS NOT NULL AND n = 1 THEN p WHEN p IS NOT NULL THEN p || ' +' || (n - 1) WHEN n = 1 THEN '1 change' ELSE n || ' changes' END AS label FROM commits",
}


def capped(cap: int) -> dict[str, str]:
    return {
        "top": f"SELECT l.*, lane FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY c DESC) AS k FROM labelled) l JOIN lanes USING (branch_id) WHERE k <= {cap}",
        "chained": "SELECT *, lag(commit_id) OVER (PARTITION BY branch_id ORDER BY c) AS before FROM top",
        "forks": "SELECT f.branch_id, coalesce(arg_max(t.commit_id, t.c) FILTER (WHERE t.lamport <= f.fork), arg_max(t.commit_id, t.c)) AS at FROM lanes f JOIN top t ON t.branch_id = f.parent WHERE f.branch_id <> 'main' GROUP BY f.branch_id",
        "nodes": "SELECT c.*, coalesce(c.before, f.at) AS parent FROM chained c LEFT JOIN forks f ON f.branch_id = c.branch_id",
    }


GALL = {"allb": ALL_BRANCHES, **GRAPH}
LOGB = ("log", "branches")
REQ = f"SELECT * FROM (VALUES (0, 'main', {T(0.2)}), (1, 'b1', {T(0.5)}), (2, 'b2', {T(0.8)}), (3, 'b1', {T(1.0)})) v(request, branch_id, t)"
VMAIN = "SELECT * EXCLUDE (target) FROM vis WHERE target = 'main'"
VB1 = "SELECT * EXCLUDE (target) FROM vis WHERE target = 'b1'"


def upto(share: float, of: str = "vmain") -> str:
    return f"SELECT * FROM {of} WHERE ts <= {T(share)}"


def parents(of: str) -> str:
    """Every directory above the paths of a table."""
    return f"SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path FROM (SELECT path, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS n FROM {of})"


ASOF = f"SELECT * FROM log WHERE ts <= {T(0.5)}"
EXT = ", ".join(f"'{x}'" for x in CODE_EXTENSIONS)
BASE3 = "'h1\nh2\nh3\n' || coalesce(text, '') || '\nt1\nt2\nt3\n'"
#: Anchored alternatives of the scope rules of b02, one per rule, as the contract of ignore files has them.
SCOPE = "CASE WHEN regexp_matches(path, '^page/1[^/]*(/.*)?$') THEN true WHEN regexp_matches(path, '^(.*/)?build/keep(/.*)?$') THEN false WHEN regexp_matches(path, '^(.*/)?build(/.*)?$') THEN true WHEN regexp_matches(path, '^(.*/)?[^/]*\\.log(/.*)?$') THEN true ELSE false END"


def be(x: str) -> str:
    """A number as 8 bytes."""
    return f"unhex(lpad(to_hex(cast({x} AS ubigint)), 16, '0'))"


def fld(x: str) -> str:
    return f"{be(f'strlen(coalesce({x}, {chr(39) * 2}))')} || encode(coalesce({x}, ''))"


def num(x: str) -> str:
    return f"{be('8')} || {be(x)}"


ROW_ID = " || ".join(
    [fld("site_id"), num("lamport"), num("seq"), num("ts"), fld("file_id"), fld("kind"), fld("merge_class"), fld("parent"), fld("base_hash"),
     fld("result_hash"), fld("path"), fld("branch_id"), fld("''")]
)

OWN_PATHS = "SELECT * REPLACE (CASE WHEN path IS NOT NULL THEN file_id || '/' || path END AS path) FROM log"

#: Two levels of directories: hosts, whose entries are pages, and the root.
GIT = {
    "hosts": "SELECT dir, string_agg(line, '' ORDER BY name) AS body FROM (SELECT regexp_extract(url, '//([^/?#]+)', 1) AS dir, 'p' || page_id AS name, hex(encode('100644 p' || page_id)) || '00' || upper(sha1(encode('blob ' || strlen(html)) || '\\x00'::BLOB || encode(html))) AS line FROM pages) GROUP BY 1",
    "host_trees": "SELECT dir, sha1(unhex(hex(encode('tree ' || (length(body) // 2))) || '00' || body)) AS tree_id FROM hosts",
    "trees": "SELECT * FROM host_trees UNION ALL SELECT '', sha1(unhex(hex(encode('tree ' || (length(body) // 2))) || '00' || body)) FROM (SELECT string_agg(hex(encode('40000 ' || dir)) || '00' || upper(tree_id), '' ORDER BY dir || '/') AS body FROM host_trees)",
}

ORACLES: dict[str, str] = {
    "a02_changed_files": """WITH l AS (SELECT 'd' || doc_id AS path, doc_id AS mtime, strlen(text) AS size, text, doc_id FROM documents),
k AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN mtime - 1 ELSE mtime END AS mtime, size, sha256(text) AS h FROM l WHERE doc_id % 3 <> 0)
SELECT coalesce(l.path, k.path) AS path, CASE WHEN l.path IS NULL THEN NULL ELSE sha256(l.text) END AS content_hash,
CASE WHEN l.path IS NULL THEN 'vanished' WHEN l.mtime IS NOT DISTINCT FROM k.mtime AND l.size IS NOT DISTINCT FROM k.size THEN 'cached' ELSE 'hashed' END AS status
FROM (SELECT * FROM l WHERE doc_id % 5 <> 0) l FULL JOIN k ON l.path = k.path""",
    "a03_read_log": oracle("SELECT id, file_id, lamport, kind, 'main' AS branch_id, cast(NULL AS varchar) AS merge_parent FROM log ORDER BY lamport, site_id, id", "log"),
    "a04_rows_for_files": oracle("SELECT id, file_id, kind FROM log WHERE file_id IN (SELECT file_id FROM log WHERE kind = 'delete')", "log"),
    "a05_meta_rows": oracle("SELECT id, file_id FROM meta WHERE kind = 'tag'", "meta"),
    "a06_append_log": oracle("SELECT id FROM log WHERE lamport % 3 = 1", "log"),
    "a07_integrate": oracle(f"SELECT sha256({ROW_ID}) AS id, lamport AS position, lamport % 3 = 1 AS is_new FROM log UNION ALL SELECT sha256({ROW_ID}), lamport + 10000000, false FROM log WHERE lamport % 4 = 0", "log"),
    "a08_put_blobs": "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)",
    "a09_get_blobs": oracle("SELECT * FROM blobs WHERE content_hash IN (SELECT result_hash FROM log WHERE kind = 'create')", "log", "blobs"),
    "a10_sync_files": oracle(
        "SELECT coalesce(a.file_id, b.file_id) AS file_id, CASE WHEN b.file_id IS NULL THEN 'insert' WHEN a.file_id IS NULL THEN 'delete' ELSE 'update' END AS action FROM st_log a FULL JOIN st_old b ON a.file_id = b.file_id WHERE a.path IS DISTINCT FROM b.path OR a.result_hash IS DISTINCT FROM b.result_hash OR a.deleted IS DISTINCT FROM b.deleted",
        "log", old=ASOF, fold=("log", "old"),
    ),
    "a10_upsert_files": oracle("SELECT file_id, path, result_hash, deleted FROM st_log", "log", fold=("log",)),
    "a11_replace_files": oracle("SELECT file_id, path, result_hash, deleted FROM st_log", "log", fold=("log",)),
    "a12_export_state": oracle("SELECT * FROM blobs WHERE content_hash IN (SELECT base_hash FROM log UNION SELECT result_hash FROM log)", "log", "blobs"),
    "a13_import_state": oracle("SELECT count(*) AS new_rows FROM log WHERE lamport % 4 = 0", "log"),
    "a14_bundle_wire": oracle("SELECT id, cast(CASE WHEN base_hash IS NULL AND result_hash IS NULL THEN 0 WHEN base_hash IS NULL OR result_hash IS NULL OR base_hash = result_hash THEN 1 ELSE 2 END AS bigint) AS n_blobs FROM log", "log"),
    "a15_dedup_shipped_blobs": oracle(
        "SELECT site_id, seq, h AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY site_id, seq) AS k FROM (SELECT DISTINCT site_id, seq, h FROM (SELECT site_id, seq, base_hash AS h FROM log UNION ALL SELECT site_id, seq, result_hash FROM log) WHERE h IS NOT NULL)) WHERE k = 1", "log"
    ),
    "a16_decode_records": oracle("SELECT id, branch_id, name, parent, created_lamport, deleted FROM brec", "meta", brec=BREC),
    "a17_load_old_log": oracle("SELECT id, branch_id, cast(NULL AS varchar) AS merge_parent FROM log", "log"),
    "b01_classify": f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'binary' WHEN doc_id % 5 IN (0, 4) THEN CASE WHEN 'py' IN ({EXT}) THEN 'code' END ELSE 'text' END AS merge_class FROM documents",
    "b02_in_scope": oracle(f"SELECT page_id, path, NOT ({SCOPE}) AS in_scope FROM p", p=PATHS),
    "b03_live_files": oracle("SELECT file_id, path FROM st_log WHERE NOT deleted", "log", fold=("log",)),
    "b04_live_file_by_path": oracle("SELECT path, file_id FROM st_log WHERE NOT deleted AND path IN (SELECT path FROM log WHERE kind = 'rename')", "log", fold=("log",)),
    "b05_content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "b06_merkle_id": oracle(f"SELECT lamport, sha256({ROW_ID}) AS id FROM log", "log"),
    "b07_id_valid": oracle("SELECT lamport, lamport % 50 <> 0 AS valid FROM log", "log"),
    "b08_blob_valid": oracle("SELECT content_hash, length(text) % 2 <> 0 AS valid FROM blobs", "blobs"),
    "b09_record_ids": oracle(f"SELECT id, sha256({fld('name')} || {num('at_ts')} || {fld('branch_id')} || {num('lamport')} || {fld('site_id')}) AS tag_id FROM trec", "meta", trec=TREC),
    "b11_as_of_filter": oracle(f"SELECT id FROM log WHERE ts <= {T(0.5)}", "log"),
    "b17_access_audit": "SELECT c_custkey AS key_id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 1000000 WHEN c_custkey % 5 = 0 THEN NULL ELSE ((500000000 + 30 * 86400) // 86400 + 1) * 86400 END AS expires_at, c_custkey % 5 = 0 AS never, c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR 500000000 < c_custkey * 1000000 AS valid FROM customer",
    "b18_counts": "SELECT doc_id, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS bigint) AS words, cast(CASE WHEN text = '' THEN 0 ELSE len(string_split(rtrim(text, chr(10)), chr(10))) END AS bigint) AS lines FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN chr(10) || chr(10) ELSE text END AS text FROM documents)",
    "b19_has_frontmatter": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text IS NOT NULL WHEN doc_id % 3 = 1 THEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '---')) > 0 ELSE false END AS has_frontmatter FROM documents",
    "b20_markdown_links": "SELECT page_id, cast(k AS bigint) AS place, CASE k WHEN 0 THEN url WHEN 1 THEN 'a/b.png' ELSE 't' || page_id END AS target FROM pages, (VALUES (0), (1), (2)) v(k)",
    "b21_lang_of": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'js' WHEN 2 THEN 'zzz' WHEN 3 THEN 'sh' WHEN 4 THEN 'css' ELSE 'txt' END AS lang FROM pages",
    "b23_git_blob_oid": "SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS oid FROM documents",
    "c01_missing_rows": oracle("SELECT id, log.site_id, seq FROM log LEFT JOIN (SELECT site_id, max(seq) // 2 AS s FROM log WHERE site_id <> 's4' GROUP BY 1) v ON v.site_id = log.site_id WHERE seq > coalesce(s, -1)", "log"),
    "c02_page_after": oracle("SELECT id, seq FROM log WHERE site_id = 's2' AND seq > 100 ORDER BY seq LIMIT 256", "log"),
    "c03_visible_rows": oracle("SELECT target, id FROM vis", *LOGB, **VIS),
    "c04_parent_of": oracle("SELECT a.id, a.parent FROM log a JOIN log b ON a.parent = b.id AND a.file_id = b.file_id", "log"),
    "c04_cross_file_parents": oracle("SELECT a.id, b.file_id AS parent_file FROM (SELECT * REPLACE (CASE WHEN lamport % 500 = 0 THEN 'r0' ELSE parent END AS parent) FROM log) a JOIN log b ON a.parent = b.id WHERE a.file_id <> b.file_id", "log"),
    "c05_infer_renames": oracle(RENAMES.format(old="o", new="n"), o=OLD, n=NEW),
    "c06_content_of": oracle("SELECT file_id, text FROM st_lin JOIN blobs ON result_hash = content_hash WHERE NOT deleted", "lin", "blobs", fold=("lin",)),
    "c07_tag_lane": oracle("SELECT tag_id, tl.branch_id, coalesce(lane, 0) AS lane FROM tl LEFT JOIN lanes ON lanes.branch_id = tl.branch_id", "meta", "branches", allb=ALL_BRANCHES, lanes=GRAPH["lanes"], trec=TREC, tl=TLWW),
    "c08_fork_edge": oracle("SELECT n.branch_id, n.parent AS fork_commit FROM nodes n WHERE n.before IS NULL AND n.branch_id <> 'main'", *LOGB, **GALL, **capped(100_000)),
    "c09_file_at": oracle(
        f"SELECT p.path, p.t, v.path IS NOT NULL AS found, v.result_hash, CASE WHEN v.path IS NOT NULL THEN coalesce(v.content, blobs.text, '') END AS content FROM (SELECT DISTINCT path, unnest([{T(0.3)}, {T(0.6)}, {T(0.9)}]) AS t FROM own WHERE path IS NOT NULL) p LEFT JOIN v_own v ON v.path = p.path AND NOT v.deleted AND v.valid_from <= p.t AND (v.valid_to IS NULL OR p.t < v.valid_to) LEFT JOIN blobs ON blobs.content_hash = v.result_hash",
        "log", "blobs", own=OWN_PATHS, lives=("own",),
    ),
    "c10_unreferenced": oracle("SELECT content_hash FROM blobs WHERE content_hash NOT IN (SELECT result_hash FROM st_log WHERE NOT deleted)", "log", "blobs", fold=("log",)),
    "d01_version_vector": oracle("SELECT site_id, max(seq) AS seq FROM log GROUP BY 1", "log"),
    "d02_visible_version_vector": oracle("SELECT site_id, max(seq) AS seq FROM vis WHERE target = 'b2' GROUP BY 1", *LOGB, **VIS),
    "d03_status": oracle("SELECT count(*) AS rows, max(ts) AS last_ts, max(lamport) AS max_lamport, (SELECT count(*) FROM st_log WHERE NOT deleted) AS live_files FROM log", "log", fold=("log",)),
    "d04_next_counters": oracle("SELECT site_id, max(seq) + 1 AS next_seq, (SELECT max(lamport) + 1 FROM log) AS next_lamport FROM log GROUP BY 1", "log"),
    "d05_reconcile_branches": oracle("SELECT branch_id, name, parent, created_lamport, deleted FROM bl", "meta", brec=BREC, bl=BLWW),
    "d06_reconcile_tags": oracle("SELECT * FROM tl", "meta", trec=TREC, tl=TLWW),
    "d07_live_branches": oracle("SELECT branch_id, name FROM bl WHERE NOT deleted", "meta", brec=BREC, bl=BLWW),
    "d08_tip": oracle(f"SELECT file_id, arg_max(id, {KEY}) AS tip FROM vis WHERE target = 'b1' AND kind NOT IN ('branch','tag') GROUP BY 1", *LOGB, **VIS),
    "d09_latest_record": oracle(f"SELECT file_id, kind, arg_max(id, {KEY}) AS id FROM meta GROUP BY 1, 2", "meta"),
    "d10_first_seen": oracle("SELECT path, min(ts) AS first_ts FROM (SELECT ts, coalesce(last_value(path IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY lamport, site_id, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS path FROM log) GROUP BY 1", "log"),
    "d11_tag_points": oracle("SELECT cast(r.request AS bigint) AS request, max(lamport) AS at_lamport FROM req r LEFT JOIN vis ON vis.target = r.branch_id AND vis.ts <= r.t GROUP BY 1", *LOGB, **VIS, req=REQ),
    "d12_dir_tree": oracle("SELECT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS dir, count(*) AS n_files, cast(sum(size) AS bigint) AS bytes FROM (SELECT *, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS n FROM p) GROUP BY 1", p=PATHS),
    "d14_git_tree": oracle("SELECT * FROM trees", **GIT),
    "d14_git_tree_again": oracle("SELECT * FROM trees", **GIT),
    "d14_git_commit": oracle("SELECT tree_id, sha1(encode('commit ' || strlen(body)) || '\\x00'::BLOB || encode(body)) AS commit_id FROM (SELECT tree_id, 'tree ' || tree_id || chr(10) || 'author store <store@example.org> 1700000000 +0000' || chr(10) || 'committer store <store@example.org> 1700000000 +0000' || chr(10) || chr(10) || 'derived snapshot' || chr(10) AS body FROM trees WHERE dir = '')", **GIT),
    "d15_content_groups": oracle("SELECT content_hash, count(h) AS refs FROM blobs LEFT JOIN (SELECT base_hash AS h FROM log UNION ALL SELECT result_hash FROM log) ON h = content_hash GROUP BY 1", "log", "blobs"),
    "d16_kind_counts": oracle("SELECT kind, site_id, branch_id, count(*) AS n FROM log GROUP BY ALL", "log"),
    "e01_history": oracle("SELECT id, file_id, kind, coalesce(last_value(path IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY lamport, site_id, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS path FROM log", "log"),
    "e02_settle_commits": oracle("SELECT branch_id, commit_id, lamport, n, label FROM labelled", *LOGB, **GALL),
    "e04_cap_per_lane": oracle("SELECT branch_id, commit_id FROM top", *LOGB, **GALL, **capped(50)),
    "e05_chain_parents": oracle("SELECT commit_id, parent FROM nodes WHERE branch_id = 'main'", *LOGB, **GALL, **capped(50)),
    "e06_lanes": oracle("SELECT branch_id, row_number() OVER (ORDER BY branch_id <> 'main', created_lamport, branch_id) - 1 AS lane FROM bm WHERE NOT deleted", "meta", brec=BREC, bl=BLWW, bm=BMAIN),
    "e07_assign_counters": "SELECT doc_id, 999 + row_number() OVER (ORDER BY doc_id) AS seq FROM documents",
    "e08_seq_gaps": oracle("SELECT site_id, seq AS after, nx - seq - 1 AS missing FROM (SELECT site_id, seq, lead(seq) OVER (PARTITION BY site_id ORDER BY seq) AS nx FROM (SELECT DISTINCT site_id, seq FROM l2)) WHERE nx > seq + 1 UNION ALL SELECT site_id, seq, 0 FROM l2 GROUP BY 1, 2 HAVING count(*) > 1", "log", l2="SELECT * FROM log WHERE lamport % 97 <> 0 UNION ALL SELECT * FROM log WHERE lamport % 500 = 1"),
    "e09_fork_edges": oracle("SELECT branch_id, lane, min(ts) AS first_ts FROM log JOIN lanes USING (branch_id) GROUP BY 1, 2", *LOGB, allb=ALL_BRANCHES, lanes=GRAPH["lanes"]),
    "f01_sort_by_order_key": oracle("SELECT id, lamport FROM log ORDER BY lamport, site_id, id", "log"),
    "f02_newest": oracle("SELECT id, ts FROM log ORDER BY lamport DESC, site_id DESC, id DESC LIMIT 200", "log"),
    "f04_union_logs": oracle("SELECT DISTINCT id FROM log", "log"),
    "f05_diff_states": oracle("SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'create' WHEN n.path IS NULL THEN 'delete' ELSE 'edit' END AS action FROM o FULL JOIN n ON o.path = n.path WHERE o.h IS DISTINCT FROM n.h", o=OLD, n=NEW),
    "f06_capture_diff": oracle(
        "SELECT new_path AS path, 'rename' AS action FROM rn UNION ALL SELECT path, action FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'create' WHEN n.path IS NULL THEN 'delete' ELSE 'edit' END AS action FROM o2 o FULL JOIN n2 n ON o.path = n.path WHERE o.h IS DISTINCT FROM n.h) WHERE path NOT IN (SELECT old_path FROM rn UNION SELECT new_path FROM rn)",
        o=OLD, n=NEW, o2="SELECT * FROM o WHERE path NOT LIKE '%.log'", n2="SELECT * FROM n WHERE path NOT LIKE '%.log'", rn=RENAMES.format(old="o2", new="n2"),
    ),
    "f08_missing_deletes": oracle("SELECT path FROM o WHERE path NOT LIKE '%.log' AND path NOT IN (SELECT path FROM n)", o=OLD, n=NEW),
    "g01_fold_order": oracle("SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY lamport, site_id, id) AS position FROM log", "log"),
    "g02_fold_linear": oracle("SELECT file_id, path, result_hash, merge_class, deleted, lamport, site_id, needs_merge FROM ln_log", "log", fold=("log",)),
    "g03_needs_merge": oracle("SELECT file_id FROM ln_log WHERE needs_merge", "log", fold=("log",)),
    "g05_merge3": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256('ours' || chr(10) || coalesce(text, '')) WHEN 1 THEN sha256(coalesce(text, '') || chr(10) || 'theirs') WHEN 2 THEN sha256(coalesce(text, '')) ELSE sha256('new' || chr(10)) END AS merged_hash, false AS conflict FROM documents",
    "g05_merge3_hunks": f"SELECT doc_id, sha256(regexp_replace(regexp_replace({BASE3}, '^h1\nh2', 'h1\nours'), 't2\nt3\n$', 'theirs\nt3\n')) AS merged_hash, false AS conflict FROM documents",
    "g06_resolve_paths": oracle("SELECT file_id, path, deleted, result_hash FROM res_log", "log", fold=("log",)),
    "g07_current_files_linear": oracle("SELECT file_id, path, result_hash, lamport FROM res_lin WHERE NOT deleted", "lin", fold=("lin",)),
    "g08_refold": oracle("SELECT file_id, path, result_hash, deleted, lamport, conflict FROM st_log", "log", fold=("log",)),
    "g08_refold_paths": oracle("SELECT * EXCLUDE (content) FROM res_log", "log", fold=("log",)),
    "g10_line_diff": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN t = '' THEN 1 ELSE len(l) + 1 END ELSE 0 END AS line, '' AS removed, CASE doc_id % 3 WHEN 0 THEN CASE WHEN t = '' THEN 'top|' ELSE 'top' END WHEN 1 THEN CASE WHEN t = '' THEN '|end' ELSE 'end' END ELSE '' END AS added, CASE WHEN doc_id % 3 = 1 AND t <> '' THEN array_to_string(list_slice(l, -2, -1), '|') ELSE '' END AS context FROM (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)",
    "h01_ancestry": oracle("SELECT target, cast(depth AS bigint) AS depth, branch_id FROM lines", "meta", brec=BREC, bl=BLWW, bm=BMAIN, lines=LINEAGE.replace("{b}", "bm")),
    "h04_branch_files": oracle("SELECT file_id, path, result_hash, deleted, lamport, conflict FROM res_v1", *LOGB, **VIS, v1=VB1, fold=("v1",)),
    "h05_fork_vectors": oracle("SELECT cast(r.request AS bigint) AS request, site_id, max(seq) AS seq FROM req r JOIN vis ON vis.target = r.branch_id AND vis.ts <= r.t GROUP BY 1, 2", *LOGB, **VIS, req=REQ),
    "h06_nearest_live_ancestor": oracle("SELECT b.branch_id, coalesce((SELECT arg_min(l.branch_id, l.depth) FROM lines l JOIN bm p ON p.branch_id = l.branch_id WHERE l.target = b.branch_id AND l.depth > 0 AND NOT p.deleted), 'main') AS ancestor FROM bm b", "meta", brec=BREC, bl=BLWW, bm=BMAIN, lines=LINEAGE.replace("{b}", "bm")),
    "h08_graph": oracle("SELECT commit_id, branch_id, lane, label, parent FROM nodes", *LOGB, **GALL, **capped(200)),
    "h09_compare_branches": oracle("SELECT coalesce(a.path, b.path) AS path, a.result_hash AS hash_a, b.result_hash AS hash_b FROM (SELECT * FROM res_va WHERE NOT deleted) a FULL JOIN (SELECT * FROM res_vb WHERE NOT deleted) b ON a.path = b.path WHERE a.result_hash IS DISTINCT FROM b.result_hash", *LOGB, **VIS, va=VMAIN, vb=VB1, fold=("va", "vb")),
    "t01_state_as_of": oracle("SELECT file_id, path, result_hash FROM res_old WHERE NOT deleted", *LOGB, **VIS, vmain=VMAIN, old=upto(0.5), fold=("old",)),
    "t02_file_at_missing": oracle("SELECT DISTINCT l.path, s.path IS NOT NULL AS found, s.result_hash, s.content FROM log l LEFT JOIN (SELECT * FROM res_old WHERE NOT deleted) s ON s.path = l.path WHERE l.path IS NOT NULL", *LOGB, **VIS, vmain=VMAIN, old=upto(0.5), fold=("old",)),
    "t03_snapshot": oracle("SELECT 'half' AS label, file_id, path, result_hash FROM res_old WHERE NOT deleted", *LOGB, **VIS, vb=VB1, old=upto(0.5, "vb"), fold=("old",)),
    "t04_snapshot_by_label": oracle("SELECT 'l' || (lamport % 7) AS label, arg_max(id, lamport) AS snapshot_id FROM log WHERE kind = 'rename' GROUP BY 1", "log"),
    "t05_restore": oracle(
        f"SELECT c.kind, row_number() OVER (ORDER BY c.p, c.fid) - 1 AS seq, 1000000000 + row_number() OVER (ORDER BY c.p, c.fid) - 1 AS lamport, t.tip AS parent, c.have AS base_hash, c.want AS result_hash, CASE WHEN c.kind = 'create' THEN c.p END AS path, true AS valid FROM (SELECT coalesce(a.path, b.path) AS p, coalesce(a.file_id, '') AS fid, a.file_id AS f, a.result_hash AS have, b.result_hash AS want, CASE WHEN a.path IS NULL THEN 'create' WHEN b.path IS NULL THEN 'delete' ELSE 'edit' END AS kind FROM (SELECT * FROM res_vmain WHERE NOT deleted) a FULL JOIN (SELECT * FROM res_old WHERE NOT deleted) b ON a.path = b.path WHERE a.result_hash IS DISTINCT FROM b.result_hash) c LEFT JOIN (SELECT file_id, arg_max(id, {KEY}) AS tip FROM vmain GROUP BY 1) t ON t.file_id = c.f",
        *LOGB, **VIS, vmain=VMAIN, old=upto(0.5), fold=("vmain", "old"),
    ),
    "t07_file_versions": oracle("SELECT * EXCLUDE (content) FROM v_log", "log", lives=("log",)),
    "t08_state_at_tags": oracle(
        "SELECT split_part(file_id, '@', 1) AS tag_id, split_part(file_id, '@', 2) AS file_id, split_part(path, '@', 2) AS path, result_hash FROM res_x WHERE NOT deleted",
        "log", "branches", "meta", **VIS, trec=TREC, tl=TLWW, x="SELECT l.* EXCLUDE (target) REPLACE (t.tag_id || '@' || l.file_id AS file_id, t.tag_id || '@' || l.path AS path) FROM vis l JOIN tl t ON l.target = t.branch_id AND l.ts <= t.at_ts", fold=("x",),
    ),
    "t09_activity": oracle("SELECT ts // step * step AS bucket, kind, count(*) AS n FROM log, (SELECT coalesce(min(v), 2592000) AS step FROM (VALUES (300), (900), (1800), (3600), (10800), (21600), (43200), (86400), (172800), (604800), (1209600), (2592000)) s(v) WHERE v >= (SELECT max(ts) - min(ts) FROM log) / 6) GROUP BY 1, 2", "log"),
    "v01_put_embeddings": "SELECT cast(vec_id AS varchar) AS content_hash, round(cast(embedding[1] AS double) * CASE WHEN vec_id % 10 = 3 THEN 2 ELSE 1 END, 5) AS first FROM embeddings",
    "v02_search": "SELECT query, rank, id FROM (SELECT q.vec_id AS query, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::double[], q.embedding::double[]) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5",
    "v05_first_divergence": oracle(f"SELECT file_id, arg_min(id, {KEY}) AS id, arg_min(CASE WHEN lamport % 40 = 1 THEN 'a' ELSE 'b' END, {KEY}) AS only_in FROM log WHERE lamport % 40 IN (0, 1) GROUP BY 1", "log"),
    "v06_blob_gc": oracle(
        f"SELECT content_hash FROM (SELECT content_hash FROM blobs UNION SELECT result_hash FROM st_log WHERE made) WHERE content_hash NOT IN (SELECT result_hash FROM st_log WHERE NOT deleted AND result_hash IS NOT NULL UNION SELECT h FROM (SELECT base_hash AS h FROM log WHERE ts >= {T(0.7)} UNION SELECT result_hash FROM log WHERE ts >= {T(0.7)}) WHERE h IS NOT NULL UNION SELECT result_hash FROM res_old WHERE NOT deleted)",
        "log", "blobs", "branches", **VIS, vmain=VMAIN, old=upto(0.5), fold=("log", "old"),
    ),
    "v07_dedup_branch_names": oracle("SELECT branch_id, CASE WHEN k = 1 THEN name ELSE name || ' (' || k || ')' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_lamport, branch_id) AS k FROM bl)", "meta", brec=BREC, bl=BLWW),
    "s01_stream_integrate": oracle(f"SELECT sha256({ROW_ID}) AS id, file_id FROM log", "log"),
    "s02_stream_fold": oracle("SELECT file_id, path, result_hash, deleted, lamport, conflict FROM st_log", "log", fold=("log",)),
    "s04_stream_version_vector": oracle("SELECT site_id, max(seq) AS seq FROM log GROUP BY 1", "log"),
    "s05_stream_status": oracle("SELECT count(*) AS rows, max(ts) AS last_ts, max(lamport) AS max_lamport FROM log", "log"),
    "s06_stream_activity": oracle("SELECT ts // 86400 * 86400 AS bucket, kind, count(*) AS n FROM log GROUP BY 1, 2", "log"),
    "s06_stream_activity_sliding": oracle("SELECT ts // 21600 * 21600 - k * 21600 AS bucket, kind, count(*) AS n FROM log, generate_series(0, 3) v(k) GROUP BY 1, 2", "log"),
    "s03_stream_debounce": oracle(
        f"SELECT file_id, site_id, min(ts) AS started, arg_min(base_hash, {KEY}) AS base_hash, arg_max(result_hash, {KEY}) AS result_hash, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY file_id, site_id, ts // 86400 ORDER BY ts, id) AS burst FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY file_id, site_id, ts // 86400 ORDER BY ts, id) <= 600 THEN 0 ELSE 1 END AS fresh FROM log WHERE kind IN ('create','edit'))) GROUP BY file_id, site_id, ts // 86400, burst HAVING arg_min(coalesce(base_hash, ''), {KEY}) <> arg_max(result_hash, {KEY})",
        "log",
    ),
    "s08_stream_files_delta": oracle(
        "SELECT file_id, arg_max(action, k) AS last_action, count(*) FILTER (action = 'insert') AS inserts FROM (" + " UNION ALL ".join(
            f"SELECT a.file_id, {k} AS k, CASE WHEN b.file_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM st_b{k} a LEFT JOIN st_b{k - 1} b ON a.file_id = b.file_id WHERE b.file_id IS NULL OR a.path IS DISTINCT FROM b.path OR a.result_hash IS DISTINCT FROM b.result_hash OR a.deleted IS DISTINCT FROM b.deleted"
            for k in range(1, 5)
        ) + ") GROUP BY 1",
        "log", b0="SELECT * FROM log WHERE false", **{f"b{k}": f"SELECT * FROM log WHERE substr(sha256(id), 1, 1) < '{d}'" for k, d in zip(range(1, 5), "48cg", strict=True)}, fold=("b0", "b1", "b2", "b3", "b4"),
    ),
    "s07_stream_records": oracle("SELECT branch_id, name, parent, created_lamport, deleted FROM bl", "meta", brec=BREC, bl=BLWW),
    "a01_scan_tree": "SELECT 'lang=' || coalesce(lang, 'none') AS dir, cast(sum(strlen(coalesce(text, '')) + 1) AS bigint) AS bytes FROM documents WHERE coalesce(lang, 'none') <> 'de' GROUP BY 1",
    "d13_tree_hash": oracle("SELECT sha256(string_agg(file_id || chr(0) || path || chr(0) || result_hash || chr(10), '' ORDER BY file_id || chr(0) || path)) AS tree_hash, count(*) AS files FROM res_old WHERE NOT deleted", *LOGB, **VIS, vmain=VMAIN, old=upto(0.5), fold=("old",)),
    "f07_dir_entities": oracle(
        "SELECT path, 'create' AS action FROM (SELECT path || '/empty' AS path FROM pv) WHERE path NOT IN (SELECT path FROM po) AND path NOT IN (SELECT path FROM pv) UNION ALL SELECT path, 'delete' FROM po WHERE path IN (SELECT path FROM pn) OR path NOT IN (SELECT path || '/empty' FROM pv)",
        o=OLD, n=NEW, v="SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)", po=parents("o"), pn=parents("n"), pv=parents("v"),
    ),
    "f09_author_rows": oracle(
        f"SELECT c.file_id, 'edit' AS kind, row_number() OVER (ORDER BY c.path, c.file_id) - 1 AS seq, t.tip AS parent, c.have AS base_hash, c.want AS result_hash, true AS valid FROM (SELECT a.file_id, a.path, a.result_hash AS have, b.result_hash AS want FROM res_now a JOIN res_old b ON a.file_id = b.file_id WHERE NOT a.deleted AND NOT b.deleted AND a.result_hash IS DISTINCT FROM b.result_hash) c JOIN (SELECT file_id, arg_max(id, {KEY}) AS tip FROM vmain GROUP BY 1) t ON t.file_id = c.file_id",
        *LOGB, **VIS, vmain=VMAIN, old=upto(0.5), now=upto(1.0), fold=("old", "now"),
    ),
    "g04_fold_merge": oracle("SELECT file_id, path, result_hash, merge_class, deleted, lamport, site_id, conflict, CASE WHEN made THEN content END AS content FROM st_log", "log", fold=("log",)),
    "g07_current_files": oracle("SELECT * EXCLUDE (content) FROM res_log", "log", fold=("log",)),
    "g09_conflicts": oracle("SELECT file_id, path FROM st_log WHERE conflict", "log", fold=("log",)),
    "h02_visibility_caps": oracle(
        "SELECT target, branch_id, NULL AS site_id, NULL AS cap FROM lines WHERE depth = 0 UNION ALL SELECT l.target, l.branch_id, g.site, min(g.cap) FROM lines l JOIN (SELECT target, depth, site, cap FROM lines x JOIN (SELECT branch_id, 's0' AS site, s0 AS cap FROM bl UNION ALL SELECT branch_id, 's1', s1 FROM bl) v ON v.branch_id = x.branch_id) g ON g.target = l.target AND g.depth < l.depth GROUP BY l.target, l.branch_id, l.depth, g.site HAVING count(*) = l.depth",
        "meta", brec=BREC, bl=BLWW, bm=BMAIN, lines=LINEAGE.replace("{b}", "bm"),
    ),
    "t06_restore_files_at": oracle(
        f"SELECT c.kind, row_number() OVER (ORDER BY c.p, c.fid) - 1 AS seq, 1000000000 + row_number() OVER (ORDER BY c.p, c.fid) - 1 AS lamport, t.tip AS parent, c.have AS base_hash, c.want AS result_hash, CASE WHEN c.kind = 'create' THEN c.p END AS path, true AS valid FROM (SELECT b.path AS p, coalesce(a.file_id, '') AS fid, a.file_id AS f, a.result_hash AS have, b.result_hash AS want, CASE WHEN a.path IS NULL THEN 'create' ELSE 'edit' END AS kind FROM (SELECT path, result_hash FROM res_old WHERE NOT deleted AND length(path) % 2 = 0 UNION ALL SELECT path, result_hash FROM res_mid WHERE NOT deleted AND length(path) % 2 = 1) b LEFT JOIN (SELECT * FROM res_vmain WHERE NOT deleted) a ON a.path = b.path WHERE b.path IN (SELECT path FROM log WHERE kind = 'rename') AND a.result_hash IS DISTINCT FROM b.result_hash) c LEFT JOIN (SELECT file_id, arg_max(id, {KEY}) AS tip FROM vmain GROUP BY 1) t ON t.file_id = c.f",
        *LOGB, **VIS, vmain=VMAIN, old=upto(0.4), mid=upto(0.7), fold=("vmain", "old", "mid"),
    ),
    "t10_diff_versions": oracle(
        "SELECT path, p + 1 AS line, array_to_string(list_slice(a, p + 1, len(a) - s), '|') AS removed, array_to_string(list_slice(b, p + 1, len(b) - s), '|') AS added FROM (SELECT *, coalesce(list_min(list_filter(generate_series(1, m - p), lambda i: a[len(a) + 1 - i] <> b[len(b) + 1 - i])) - 1, m - p) AS s FROM (SELECT *, coalesce(list_min(list_filter(generate_series(1, m), lambda i: a[i] <> b[i])) - 1, m) AS p FROM (SELECT path, a, b, least(len(a), len(b)) AS m FROM (SELECT x.path, string_split(x.content, chr(10)) AS a, string_split(y.content, chr(10)) AS b FROM res_old x JOIN res_now y ON x.path = y.path WHERE NOT x.deleted AND NOT y.deleted AND x.content <> y.content AND x.path IN (SELECT path FROM log WHERE path IS NOT NULL)))))",
        *LOGB, **VIS, vmain=VMAIN, old=upto(0.3), now=upto(0.9), fold=("old", "now"),
    ),
    "v04_refold_with_tiebreak": oracle(
        "SELECT coalesce(a.file_id, b.file_id) AS file_id, a.result_hash AS by_lamport, b.result_hash AS by_clock FROM st_late a FULL JOIN st_clock b ON a.file_id = b.file_id WHERE a.result_hash IS DISTINCT FROM b.result_hash",
        "log", late="SELECT * REPLACE (CASE WHEN lamport % 9 = 0 THEN ts - 1000000 ELSE ts END AS ts) FROM log", clock="SELECT * REPLACE (ts AS lamport) FROM late", fold=("late",), causal=("clock",),
    ),
}
