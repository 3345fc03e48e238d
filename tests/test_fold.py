"""The fold against a plain state machine on random histories, in any order of arrival."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import fold, paths
from chronofold.operators.merge import merge_text
from chronofold.operators.timetravel import file_versions, refold_with_tiebreak, versions_at
from chronofold.sources.schemas import LOG

COLUMNS = [x.split()[0] for x in LOG.split(", ")]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def history(seed: int) -> tuple[list[dict], dict[str, str]]:
    rng = random.Random(seed)
    contents = {sha(t): t for t in ("", "a\n", "b\n", "a\nb\nc\n", "a\nx\nc\n", "a\nb\ny\n")}
    rows: list[dict] = []
    for f in range(4):
        tips: list[tuple[str, str | None]] = []
        for k in range(rng.randrange(1, 9)):
            kind = "create" if not k and rng.random() < 0.9 else rng.choice(["edit"] * 5 + ["rename", "delete", "reclass", "create", "merge"])
            parent, base = rng.choice(tips) if tips else (None, None)
            row = dict.fromkeys(COLUMNS)
            lamport = len(rows) + rng.randrange(3) - (8 if rng.random() < 0.15 else 0)  # at times below its parent's
            row |= {"id": f"r{seed}-{f}-{k}", "site_id": rng.choice("xyz"), "lamport": lamport, "seq": len(rows), "ts": len(rows), "file_id": f"f{f}", "kind": kind,
                    "merge_class": rng.choice(["text", "code"]), "parent": parent, "branch_id": "main"}
            if kind in ("create", "edit"):
                row["result_hash"] = rng.choice(list(contents))
                row["base_hash"] = base if kind == "edit" else None
                tips.append((row["id"], row["result_hash"]))
            if kind in ("create", "rename"):
                row["path"] = rng.choice(["p.md", "q.md", "p (1).md", "d/.x"])
            rows.append(row)
    return rows, contents


def machine(rows: list[dict], contents: dict[str, str], made: dict[str, str] | None = None) -> dict[str, dict]:
    """States by walking the rows one by one; `made`, if given, gets all contents, merged ones too."""
    out: dict[str, dict] = {}
    made = dict(contents) if made is None else made
    made |= contents
    left = sorted(rows, key=lambda r: (r["lamport"], r["site_id"], r["id"]))
    order: list[dict] = []
    while left:  # the smallest row whose parent is placed or unknown
        waiting = {r["id"] for r in left}
        order.append(left.pop(next(i for i, r in enumerate(left) if r["parent"] not in waiting)))
    for r in order:
        s = out.get(r["file_id"])
        key = (r["lamport"], r["site_id"], r["id"])
        if r["kind"] == "create":
            out[r["file_id"]] = {"path": r["path"], "hash": r["result_hash"], "class": r["merge_class"], "deleted": False, "conflict": False, "claim": key, "lamport": r["lamport"]}
        elif s is None or r["kind"] == "merge":
            continue
        elif r["kind"] == "delete":
            s |= {"deleted": True, "lamport": r["lamport"]}
        elif s["deleted"]:
            continue
        elif r["kind"] == "edit":
            if s["hash"] == r["base_hash"]:
                s["hash"] = r["result_hash"]
            else:
                merged, conflict = merge_text(s["class"], *(made.get(h) or "" for h in (r["base_hash"], s["hash"], r["result_hash"])))
                s["hash"] = sha(merged)
                made[s["hash"]] = merged
                s["conflict"] |= conflict
            s["lamport"] = r["lamport"]
        elif r["kind"] == "rename":
            s |= {"path": r["path"], "claim": key, "lamport": r["lamport"]}
        else:
            s |= {"class": r["merge_class"], "lamport": r["lamport"]}
    return out


def resolved(states: dict[str, dict]) -> dict[str, str]:
    taken: set[str] = set()
    out = {}
    for f, s in sorted(states.items(), key=lambda x: (x[1]["claim"], x[0])):
        if s["deleted"]:
            out[f] = s["path"] or ""
            continue
        path, n = s["path"] or "", 0
        stem, end = paths.stem_and_extension(path)
        while path in taken:
            n += 1
            path = f"{stem} ({n}){end}"
        taken.add(path)
        out[f] = path
    return out


@pytest.fixture(scope="module")
def frames(spark):
    """Twelve histories in one log, their files apart by name, in shuffled order."""
    rows, contents, parts = [], {}, []
    for seed in range(12):
        own, texts = history(seed)
        parts.append((own, texts))
        contents |= texts
        rows += [{**r, "file_id": f"h{seed}-{r['file_id']}"} for r in own]
    random.Random(5).shuffle(rows)
    log = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], LOG)
    return log, spark.createDataFrame(list(contents.items()), "content_hash string, text string"), parts


def test_fold_equals_state_machine(frames):
    log, blobs, parts = frames
    want = {f"h{i}-{f}": s for i, (rows, texts) in enumerate(parts) for f, s in machine(rows, texts).items()}
    got = {r["file_id"]: r for r in fold.states(log, blobs).collect()}
    assert got.keys() == want.keys()
    for f, s in want.items():
        r = got[f]
        assert (r["path"], r["result_hash"], r["merge_class"], r["deleted"], r["conflict"], r["lamport"]) == (s["path"], s["hash"], s["class"], s["deleted"], s["conflict"], s["lamport"]), f


def test_refold_equals_fold(frames):
    log, blobs, _ = frames
    old = log.filter("ts < 12")
    again = fold.refold(fold.states(old, blobs), log, log.filter("ts >= 12"), blobs)
    assert sorted(map(str, again.collect())) == sorted(map(str, fold.states(log, blobs).collect()))


def test_refolded_paths_equal_all_paths(frames):
    """Only families that touched files leave or enter are resolved again, and the outcome is that of resolving all."""
    log, blobs, _ = frames
    for upto in (4, 12):
        old = log.filter(F.col("ts") < upto)
        held = fold.states(old, blobs)
        now, files = fold.refold_files(held, paths.resolve_paths(held), log, log.filter(F.col("ts") >= upto), blobs)
        assert sorted(map(str, files.collect())) == sorted(map(str, paths.resolve_paths(fold.states(log, blobs)).select(*files.columns).collect()))


def test_directories_follow_refolded_files(spark):
    """A directory gives way to a file that comes to its path, and is back when the file goes."""
    row = lambda n, f, kind, path, cls: (f"r{n}", "s", n, n, n, f, kind, cls, None, None, None, path, "main", None, None)
    rows = [row(1, "d", "create", "x", "dir"), row(2, "e", "create", "x", "dir"), row(3, "g", "create", "y", "text"), row(4, "f", "create", "x", "text"), row(5, "f", "rename", "z", "text"), row(6, "e", "delete", None, "dir")]
    blobs = spark.createDataFrame([], "content_hash string, text string")
    for k in range(3, 6):
        log, old = (spark.createDataFrame(rows[:n], LOG) for n in (k + 1, k))
        held = fold.states(old, blobs)
        files = fold.refold_files(held, paths.resolve_paths(held), log, log.filter(F.col("ts") == k + 1), blobs)[1]
        assert sorted(map(str, files.collect())) == sorted(map(str, paths.resolve_paths(fold.states(log, blobs)).select(*files.columns).collect()))


def test_versions_equal_the_machine_at_any_time(spark):
    """Every life of a file, merges among them: the version at t is the state of the rows up to t."""
    rows, contents, want = [], {}, {}
    for seed in range(40, 60):
        own, texts = history(seed)
        contents |= texts
        order = machine_order(own)
        for t, r in enumerate(order):
            r |= {"ts": t, "file_id": f"h{seed}-{r['file_id']}"}
        rows += order
        for t in range(len(order)):
            for f, s in machine([r for r in order if r["ts"] <= t], texts).items():
                want[f, t] = (s["hash"], s["path"], s["deleted"])
    log = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], LOG)
    blobs = spark.createDataFrame(list(contents.items()), "content_hash string, text string")
    got: dict = {}
    for v in file_versions(log, blobs).collect():
        until = v["valid_to"] if v["valid_to"] is not None else 10**6
        for f, t in want:
            if f == v["file_id"] and v["valid_from"] <= t < until:
                got[f, t] = (v["result_hash"], v["path"], v["deleted"])
    assert got == want
    kinds = {f: [r["kind"] for r in rows if r["file_id"] == f] for f in {r["file_id"] for r in rows}}
    assert sum(k.count("create") > 1 for k in kinds.values()) > 5  # files that were created again


def machine_order(rows: list[dict]) -> list[dict]:
    left, out = sorted(rows, key=lambda r: (r["lamport"], r["site_id"], r["id"])), []
    while left:
        waiting = {r["id"] for r in left}
        out.append(left.pop(next(i for i, r in enumerate(left) if r["parent"] not in waiting)))
    return out


def test_probes_see_files_that_were_created_again(spark):
    row = lambda n, kind, text: (f"r{n}", "s", n, n, n, "f", kind, "text", None, None, text and sha(text), "p" if kind == "create" else None, "main", None, None)
    log = spark.createDataFrame([row(10, "create", "a"), row(20, "delete", None), row(30, "create", "b")], LOG)
    blobs = spark.createDataFrame([(sha(x), x) for x in "ab"], "content_hash string, text string")
    probes = spark.createDataFrame([("p", t) for t in (5, 10, 15, 20, 25, 30, 99)] + [("q", 15)], "path string, t long")
    got = {(r["path"], r["t"]): (r["found"], r["content"]) for r in versions_at(log, probes, blobs).collect()}
    no = (False, None)
    assert got == {("p", 5): no, ("p", 10): (True, "a"), ("p", 15): (True, "a"), ("p", 20): no, ("p", 25): no, ("p", 30): (True, "b"), ("p", 99): (True, "b"), ("q", 15): no}


def test_paths_equal_greedy_claims(frames):
    log, blobs, parts = frames
    rows, texts = parts[0]
    own = log.filter("file_id like 'h0-%'")
    want = {f"h0-{f}": p for f, p in resolved(machine(rows, texts)).items()}
    assert {r["file_id"]: r["path"] for r in paths.resolve_paths(fold.states(own, blobs)).collect()} == want
    every = {f"h{i}-{f}": s for i, (r, t) in enumerate(parts) for f, s in machine(r, t).items()}
    assert {r["file_id"]: r["path"] for r in paths.resolve_paths(fold.states(log, blobs)).collect()} == resolved(every)


def test_a_parent_with_a_larger_key_comes_first(spark):
    rows = [("c", "x", 1, "create", None, None, "1"), ("e1", "x", 9, "edit", "c", "1", "2"), ("e2", "x", 5, "edit", "e1", "2", "3")]
    log = spark.createDataFrame(rows, "id string, site_id string, lamport long, kind string, parent string, base_hash string, result_hash string")
    log = log.selectExpr("id", "site_id", "lamport", "lamport as seq", "lamport as ts", "'f' as file_id", "kind", "'text' as merge_class", "parent", "base_hash", "result_hash", "'p' as path", "'main' as branch_id")
    blobs = spark.createDataFrame([], "content_hash string, text string")
    row = fold.states(log, blobs).first()
    assert (row["result_hash"], row["conflict"]) == ("3", False)
    assert fold.needs_merge(log).isEmpty()


def test_clock_order_equals_the_machine_on_clock_keys(frames):
    log, blobs, parts = frames
    clocked = log.withColumn("ts", F.when(F.col("seq") % 3 == 0, F.col("ts") - 7).otherwise(F.col("ts")))
    want = {}
    for i, (rows, texts) in enumerate(parts):
        a = machine(rows, texts)
        b = machine([{**r, "lamport": r["ts"] - 7 if r["seq"] % 3 == 0 else r["ts"]} for r in rows], texts)
        want |= {f"h{i}-{f}": (s["hash"], b[f]["hash"]) for f, s in a.items() if s["hash"] != b[f]["hash"]}
    got = {r["file_id"]: (r["by_lamport"], r["by_clock"]) for r in refold_with_tiebreak(clocked, blobs).collect()}
    assert got == want


def test_causal_order_moves_children_after_parents():
    rows = [((5, "a", "p"), "p", None), ((1, "a", "c"), "c", "p"), ((2, "a", "x"), "x", "gone"), ((3, "a", "m"), "m", "n"), ((4, "a", "n"), "n", "m")]
    assert [rows[i][1] for i in fold.causal_order(rows)] == ["x", "p", "c", "m", "n"]


def test_suffix_goes_before_a_real_extension():
    assert paths.stem_and_extension("d/.x") == ("d/", ".x")
    assert paths.stem_and_extension(".gitignore") == (".gitignore", "")
    assert paths.stem_and_extension("d.e/x") == ("d.e/x", "")
    assert paths.stem_and_extension("a.tar.gz") == ("a.tar", ".gz")
