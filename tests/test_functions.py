"""Hashes, ids, scope rules and texts against restated rules and known values."""

from __future__ import annotations

import fnmatch
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chronofold.functions import ids, text
from chronofold.operators.fold import states
from chronofold.operators.merge import line_diff, merge_text
from chronofold.operators.timetravel import step_for
from chronofold.sources.schemas import LOG

COLUMNS = [x.split()[0] for x in LOG.split(", ")]


def test_content_hash(spark):
    row = spark.range(1).select(ids.content_hash(F.lit("hello\n")).alias("h"), ids.git_blob_id(F.lit("hello\n")).alias("g")).first()
    assert row["h"] == "5891b5b522d5df086d0ff0b110fbd9d21bb4fc7163af34d08286a2e846f6be03"
    assert row["g"] == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_row_id_covers_every_field(spark):
    base = dict(site_id="s", lamport=1, seq=2, ts=-5, file_id="f", kind="edit", merge_class="text", parent=None, base_hash="a", result_hash="b", path=None, branch_id="main", merge_parent=None)
    kind = "site_id string, lamport long, seq long, ts long, file_id string, kind string, merge_class string, parent string, base_hash string, result_hash string, path string, branch_id string, merge_parent string"
    changed = [base] + [{**base, k: (v + 1 if isinstance(v, int) else "x")} for k, v in base.items()]
    got = [r[0] for r in spark.createDataFrame([tuple(r.values()) for r in changed], kind).select(ids.row_id()).collect()]

    def field(v):
        data = v.to_bytes(8, "big", signed=True) if isinstance(v, int) else (v or "").encode()
        return len(data).to_bytes(8, "big") + data

    assert got == [hashlib.sha256(b"".join(field(v) for v in r.values())).hexdigest() for r in changed]
    assert len(set(got)) == len(got)


def test_scope_rules(spark):
    rules = "# note\n*.log\n!keep.log\n/build/\ndocs/**/x?\ntmp\n"
    cases = {
        "a.log": True, "d/a.log": True, "keep.log": False, "build/x": True, "d/build/x": False, "build": True, "docs/a/b/xy": True, "docs/a/xyz": False,
        "a/tmp/b": True, "tmpx": False, ".git/config": True, "a/.git": True, "a.git": False, ".store/x": True, "a.log/b": True,
    }
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", text.ignored(F.col("path"), rules).alias("i")).collect()
    assert {r["path"]: r["i"] for r in rows} == cases


@pytest.mark.parametrize("seed", range(3))
def test_single_star_globs_agree_with_fnmatch(seed):
    rng = random.Random(seed)
    for _ in range(300):
        glob = "".join(rng.choice("ab*?.") for _ in range(rng.randrange(1, 6))).replace("**", "*")
        name = "".join(rng.choice("ab.") for _ in range(rng.randrange(0, 6)))
        assert bool(re.fullmatch(text.glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob), (glob, name)


def test_classify(spark):
    rows = [("a.py", b"x"), ("a.md", b"x"), (".py", b"x"), ("d.x/Makefile", b"x"), ("a.RS", b"x\x00"), ("a.rs", b"\xff"), ("d/a.tar.JS", b"")]
    got = spark.createDataFrame(rows, "path string, data binary").select(text.classify(F.col("path"), F.col("data"))).collect()
    assert [r[0] for r in got] == ["code", "text", "text", "text", "binary", "binary", "code"]


def test_merges():
    base = "l1\nl2\nl3\n"
    assert merge_text("text", base, "A1\nl2\nl3\n", "l1\nl2\nC3\n") == ("A1\nl2\nC3\n", False)
    assert merge_text("text", "x\n", "ours\n", "theirs\n") == ("theirs\n", True)
    assert merge_text("code", "x\n", "ours\n", "theirs\n") == ("<<<<<<< A\nours\n=======\ntheirs\n>>>>>>> B\n", True)
    assert merge_text("binary", "a", "b", "c") == ("c", True)
    rng = random.Random(1)
    for _ in range(500):
        b, o = ("".join(f"{rng.randrange(8)}\n" for _ in range(rng.randrange(8))) for _ in range(2))
        for kind in ("text", "code"):
            assert merge_text(kind, b, o, o) == (o, False)
            assert merge_text(kind, b, o, b) == (o, False)
            assert merge_text(kind, b, b, o) == (o, False)


def test_line_diff(spark):
    rows = [("a\nb\nc", "a\nx\ny\nc"), ("a", "a"), ("", "q"), ("a\na", "a\na\na"), ("1\n2\n3\n4", "1\n2\n3\n5"), ("q", None)]
    got = line_diff(spark.createDataFrame(rows, "before string, after string")).select("line", "removed", "added", "context").collect()
    assert [tuple(r) for r in got] == [
        (2, ["b"], ["x", "y"], ["a"]), (0, [], [], []), (1, [], ["q"], []), (3, [], ["a"], ["a", "a"]), (4, ["4"], ["5"], ["2", "3"]), (1, ["q"], [], [])
    ]


def test_steps():
    assert [step_for(s) for s in (1, 360, 1801, 86_400 * 6, 3600 * 17, 86_400 * 80, 10**9)] == [300, 300, 900, 86_400, 10_800, 1_209_600, 2_592_000]


def test_text_rules(spark):
    one = lambda column, values: [r[0] for r in spark.createDataFrame([(x,) for x in values], "x string").select(column(F.col("x"))).collect()]
    assert one(text.lang_of, ["a.ts", "b/c.MJS", "d.scss", "e.yml", "f.zsh", "g.rs", "h.Weird", "README", "x.tar.gz", "n.a-b", "p.json"]) == [
        "js", "js", "css", "yaml", "sh", "rs", "weird", "txt", "gz", "txt", "json"
    ]
    assert one(text.line_count, ["", "\n", "\n\n", "a", "a\n\n", "a\nb", "\na"]) == [0, 1, 1, 1, 1, 2, 2]
    assert one(text.word_count, ["", " \n", "a", " a  b\tc\n", "a\u00a0b"]) == [0, 0, 1, 3, 2]
    assert one(text.has_frontmatter, ["---\r\nx\r\n---\r\n", " --- \na\n\t---", "---\nx", "x\n---\n---", "", "---\n----"]) == [True, True, False, False, False, False]


#: Three sealed rows of a published set, and what they fold to.
GOLDEN = [
    {"base_hash": None, "branch_id": "main", "file_id": "f1", "id": "7881af762febf2b6b26f646acbd6e9076018fb0413ab00f8a31fa2c6bee02dd3", "kind": "create", "lamport": 1, "merge_class": "text", "merge_parent": None, "parent": None, "path": "doc.md", "result_hash": "8f2b6a9cfba2207f332cf001304e81648aef2828d041ea880ae278c9c577a3b3", "seq": 0, "site_id": "aa", "ts": 0},
    {"base_hash": "8f2b6a9cfba2207f332cf001304e81648aef2828d041ea880ae278c9c577a3b3", "branch_id": "main", "file_id": "f1", "id": "ad1d9b05bcb76f36d90da34d0d7b971ffe3b1cb230ff2b049e0d76d642f0d0ee", "kind": "edit", "lamport": 2, "merge_class": "text", "merge_parent": None, "parent": "7881af762febf2b6b26f646acbd6e9076018fb0413ab00f8a31fa2c6bee02dd3", "path": None, "result_hash": "a6ce49ce75c612b00592e315645cf1d7e0a92efd0ad028e3cfc658ea491fb160", "seq": 1, "site_id": "aa", "ts": 0},
    {"base_hash": "8f2b6a9cfba2207f332cf001304e81648aef2828d041ea880ae278c9c577a3b3", "branch_id": "main", "file_id": "f1", "id": "382ae926d045be61a456981d72aef438f81c7ebe88eee6fcc1e195f95716c2b4", "kind": "edit", "lamport": 2, "merge_class": "text", "merge_parent": None, "parent": "7881af762febf2b6b26f646acbd6e9076018fb0413ab00f8a31fa2c6bee02dd3", "path": None, "result_hash": "bba27c56a8fe7719440912d31cfe47e5fe69fb17fe1055d1285f6ffbaf3ec4a4", "seq": 0, "site_id": "bb", "ts": 0},
]


def test_golden_rows_are_valid_and_fold(spark):
    log = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in GOLDEN], LOG)
    assert [r[0] for r in log.select(ids.id_valid()).collect()] == [True] * 3
    texts = ["l1\nl2\nl3\n", "A1\nl2\nl3\n", "l1\nl2\nC3\n"]
    blobs = spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), t) for t in texts], "content_hash string, text string")
    row = states(log, blobs).first()
    assert row["result_hash"] == hashlib.sha256(b"A1\nl2\nC3\n").hexdigest() and not row["conflict"] and row["path"] == "doc.md"


def test_branch_ids_cover_the_vector_in_any_order(spark):
    rows = [("n", "main", {"a": 1, "b": 2}, 5, "s"), ("n", "main", {"b": 2, "a": 1}, 5, "s"), ("n", "main", {"a": 1, "b": 3}, 5, "s"), ("n", "main", {}, 5, "s")]
    got = ids.branch_id_of(spark.createDataFrame(rows, "name string, parent string, fork_vv map<string,long>, created_lamport long, site_id string")).collect()
    assert got[0]["branch_id"] == got[1]["branch_id"] and len({r["branch_id"] for r in got}) == 3


def test_git_trees_are_deep_and_plan_by_level(spark):
    deep = "/".join(f"d{k}" for k in range(20)) + "/x"
    rows = spark.createDataFrame([(deep, "a" * 40), ("y", "b" * 40)], "path string, blob_id string")
    trees = {r["dir"]: r["tree_id"] for r in ids.git_trees(rows).collect()}
    want, oid, name = {}, "a" * 40, b"100644 x"
    for k in range(20, -1, -1):
        body = name + b"\0" + bytes.fromhex(oid) + (b"100644 y\0" + bytes.fromhex("b" * 40) if k == 0 else b"")
        oid = hashlib.sha1(b"tree %d\0" % len(body) + body).hexdigest()
        want["/".join(f"d{j}" for j in range(k))] = oid
        name = f"40000 d{k - 1}".encode()
    assert trees == want


def test_trees_after_changes_hash_only_directories_on_the_way(spark):
    """Ids equal those of hashing everything; the id of a directory without changes is the one that was kept."""
    rng = random.Random(9)
    paths = {"/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + f"/f{k}": f"{k:040x}" for k in range(60)} | {"top": "1" * 40}
    later = {p: ("e" * 40 if k % 9 == 0 else o) for k, (p, o) in enumerate(sorted(paths.items())) if k % 7} | {"a/new/deep/x": "2" * 40}
    frame = lambda x: spark.createDataFrame(list(x.items()), "path string, blob_id string")
    changed = {p for p in paths.keys() | later.keys() if paths.get(p) != later.get(p)}
    changed_paths = spark.createDataFrame([(p,) for p in changed], "path string")
    as_dict = lambda df: {r["dir"]: r["tree_id"] for r in df.collect()}
    old, want = ids.git_trees(frame(paths)), as_dict(ids.git_trees(frame(later)))
    assert as_dict(ids.git_trees(frame(later), old, changed_paths)) == want
    on_way = {"/".join(p.split("/")[:n]) for p in changed for n in range(p.count("/") + 1)}
    marked = old.withColumn("tree_id", F.when(F.col("dir").isin(*on_way), F.col("tree_id")).otherwise(F.sha1("dir")))
    got = as_dict(ids.git_trees(frame(later), marked, changed_paths))
    still = set(want) - on_way
    assert still and all(got[d] == hashlib.sha1(d.encode()).hexdigest() for d in still)
    gone = ids.git_trees(frame({"top": "1" * 40}), old, spark.createDataFrame([(p,) for p in paths if p != "top"], "path string"))
    assert as_dict(gone) == as_dict(ids.git_trees(frame({"top": "1" * 40})))


def test_commit_id_of_the_empty_tree(spark):
    """The literal is that of git for the same bytes."""
    row = spark.range(1).select(ids.git_commit_id(F.lit("4b825dc642cb6eb9a060e54bf8d69288fbee4904"), F.lit(1_700_000_000), "store <s@example.org>", "derived snapshot\n").alias("id")).first()
    assert row["id"] == "7aa583de45fa16e8c4cc32f3998e4a792a1c62c6"
