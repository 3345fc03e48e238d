"""Branch lines, commits over blocks, merges, and time travel on small logs by hand."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from chronofold.operators import branches as br
from chronofold.operators import fold, misc
from chronofold.operators import timetravel as tt
from chronofold.operators.merge import merge_text
from chronofold.sources.schemas import BRANCH_RECORD, LOG
from tests.test_fold import COLUMNS, machine, resolved

KIND = "id string, site_id string, lamport long, seq long, ts long, file_id string, kind string, merge_class string, parent string, base_hash string, result_hash string, path string, branch_id string, merge_parent string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def log_of(spark, rows):
    """Rows of (file, kind, base text, text, path, branch), one site, in order."""
    out = []
    for k, (f, kind, base, text, path, branch) in enumerate(rows, 1):
        out.append((f"r{k:03}", "s", k, k, k, f, kind, "text", None, base and sha(base), text and sha(text), path, branch, None))
    return spark.createDataFrame(out, KIND)


def test_a_line_of_a_hundred_branches_is_whole(spark):
    rows = [(f"b{k}", f"b{k}", f"b{k - 1}" if k else "main", {}, k, k, False) for k in range(100)]
    lines = br.ancestry(spark.createDataFrame(rows, BRANCH_RECORD))
    got = {r["branch_id"]: r["depth"] for r in lines.filter("target = 'b99'").collect()}
    assert got == {f"b{k}": 99 - k for k in range(100)} | {"main": 100}
    assert lines.filter("target = 'b9'").count() == 11


def test_commits_do_not_depend_on_blocks(spark):
    rows = [("f", "edit", None, "x", None, b) for b in "aabbaabbbaaaabab"]
    log = log_of(spark, rows).selectExpr("* except (lamport, site_id)", "lamport * lamport div 3 as lamport", "concat('s', cast(lamport div 4 % 2 as string)) as site_id")
    whole = sorted(map(str, br.settle_commits(log).collect()))
    for block in (1, 7, 20):
        assert sorted(map(str, br.settle_commits(log, block=block).collect())) == whole


def test_merge_brings_creates_deletes_and_merged_edits(spark):
    t = "1\n2\n3\n"
    ours, theirs = "A\n2\n3\n", "1\n2\nC\n"
    rows = [
        ("both", "create", None, t, "both.md", "main"), ("gone", "create", None, "g", "gone.md", "main"), ("same", "create", None, "s", "same.md", "main"), ("kept", "create", None, "k", "kept.md", "main"),
        ("both", "edit", t, ours, None, "main"), ("kept", "delete", None, None, None, "main"),
        ("both", "edit", t, theirs, None, "b"), ("gone", "delete", None, None, None, "b"), ("new", "create", None, "n", "new.md", "b"), ("kept", "edit", "k", "k2", None, "b"),
    ]
    log = log_of(spark, rows)
    branches = spark.createDataFrame([("b", "b", "main", {"s": 4}, 4, 4, False)], BRANCH_RECORD)
    blobs = spark.createDataFrame([(sha(x), x) for x in (t, ours, theirs, "g", "s", "k", "k2", "n")], "content_hash string, text string")
    got = {r["file_id"]: (r["path"], r["action"], r["want"], r["content"]) for r in br.merge_branches(log, branches, "b", "main", blobs).collect()}
    merged = "A\n2\nC\n"
    assert got == {
        "both": (None, "edit", sha(merged), merged), "gone": (None, "delete", None, None), "new": ("new.md", "create", sha("n"), "n"), "kept": ("kept.md", "create", sha("k2"), "k2"),
    }


def two_branches(seed: int) -> tuple[list[dict], dict[str, str], int]:
    """Rows of many files on main, then on main and b by turns, in order; what is authored stands on its branch's state."""
    rng = random.Random(seed)
    texts = ["", "a\n", "a\nb\nc\nd\n", "a\nx\nc\nd\n", "a\nb\nc\ny\n", "a\nz\nc\ny\n"]
    contents = {sha(t): t for t in texts}
    rows: list[dict] = []
    fork = 60

    def view(branch: str) -> list[dict]:
        return [r for r in rows if r["branch_id"] == branch or branch == "b" and r["seq"] <= fork]

    for n in range(260):
        branch = "main" if n <= fork else rng.choice(["main", "b"])
        f = f"f{rng.randrange(30)}"
        state = machine([r for r in view(branch) if r["file_id"] == f], contents).get(f)
        live = state is not None and not state["deleted"]
        kind = rng.choice(["edit"] * 5 + ["rename", "rename", "reclass", "delete"]) if live else "create"
        row = dict.fromkeys(COLUMNS) | {"id": f"r{n:03}", "site_id": "s", "lamport": n, "seq": n, "ts": n, "file_id": f, "kind": kind, "merge_class": state["class"] if live else rng.choice(["text", "code"]), "branch_id": branch}
        if kind in ("create", "edit"):
            row |= {"base_hash": state["hash"] if kind == "edit" else None, "result_hash": sha(rng.choice(texts))}
        if kind == "reclass":
            row["merge_class"] = rng.choice(["text", "code", "binary"])
        if kind in ("create", "rename"):
            row["path"] = rng.choice(["p", "q", "r"])
        rows.append(row)
    return rows, contents, fork


def test_merges_equal_brute_force_and_repeat_without_rows(spark):
    rows, contents, fork = two_branches(10)
    made: dict[str, str] = {}
    fields = lambda s: None if s is None or s["deleted"] else (s["path"], s["class"], s["hash"])
    base, ours, theirs = (
        {f: fields(s) for f, s in machine([r for r in rows if keep(r)], contents, made).items()}
        for keep in (lambda r: r["seq"] <= fork, lambda r: r["branch_id"] == "main", lambda r: r["branch_id"] == "b" or r["seq"] <= fork)
    )
    want, after = set(), dict(ours)
    for f in theirs:
        b, o, t = base.get(f), ours.get(f), theirs[f]
        if t in (b, o):
            continue
        if t is None:
            want |= {(f, "delete", None, None)} if o == b else set()
            after[f] = None if o == b else o
        elif o is None:
            want.add((f, "create", t[0], t[2]))
            after[f] = t
        else:
            b = b or (None, None, None)
            path, kind, content = (o[k] if t[k] == b[k] else t[k] for k in range(3))
            if t[2] != b[2] and o[2] != b[2] and t[2] != o[2]:
                text = merge_text(kind, *(made.get(x) or "" for x in (b[2], o[2], t[2])))[0]
                content = sha(text)
                made[content] = text
            want |= {(f, "rename", path, o[2])} if path != o[0] else set()
            want |= {(f, "reclass", None, o[2])} if kind != o[1] else set()
            want |= {(f, "edit", None, content)} if content != o[2] else set()
            after[f] = (path, kind, content)
    log = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], LOG)
    blobs = spark.createDataFrame(list(contents.items()), "content_hash string, text string")
    branches = spark.createDataFrame([("b", "b", "main", {"s": fork}, fork, fork, False)], BRANCH_RECORD)
    new, more = tt.author_merge(log, branches, "b", "main", blobs, "m", 500, 0, 500)
    new, more = new.cache(), more.cache()
    assert {(r["file_id"], r["kind"], r["path"], r["result_hash"]) for r in new.filter("kind in ('create', 'edit', 'delete')").collect()} == {x for x in want if x[1] in ("create", "edit", "delete")}
    assert {(r["file_id"], r["kind"], r["path"]) for r in new.filter("kind in ('rename', 'reclass')").collect()} == {x[:3] for x in want if x[1] in ("rename", "reclass")}
    assert len({x[1] for x in want}) == 5
    mark = new.filter("kind = 'merge'").collect()
    assert len(mark) == 1 and mark[0]["merge_parent"] == max(r["id"] for r in rows if r["branch_id"] == "b")
    # main now has the merged files; a second merge authors nothing; the graph shows a node of two parents.
    log, blobs = log.unionByName(new.withColumn("sig", F.lit(None).cast("binary"))).cache(), blobs.unionByName(more).dropDuplicates(["content_hash"]).cache()
    state = {r["file_id"]: None if r["deleted"] else (r["path"], r["merge_class"], r["result_hash"]) for r in fold.states(br.visible_rows(log, branches, "main").drop("target"), blobs).collect()}
    assert {f: s for f, s in state.items() if s} == {f: s for f, s in after.items() if s}
    again, nothing = tt.author_merge(log, branches, "b", "main", blobs, "m", 600, 50, 900)
    assert again.isEmpty() and nothing.isEmpty()
    nodes = {r["commit_id"]: r["parents"] for r in br.graph(log, branches, 10_000).collect()}
    assert [len(p) for c, p in nodes.items() if mark[0]["id"] == c] == [2] and {x for p in nodes.values() for x in p} <= set(nodes)
    # One more row of b: only its file is merged, against b as it was merged before.
    f, s = next((f, s) for f, s in sorted(state.items()) if s and theirs.get(f) and theirs[f][1] == "text")
    edit = dict.fromkeys(COLUMNS) | {"id": "z", "site_id": "s", "lamport": 2000, "seq": 2000, "ts": 2000, "file_id": f, "kind": "rename", "merge_class": "text", "path": "elsewhere", "branch_id": "b"}
    last, _ = tt.author_merge(log.unionByName(spark.createDataFrame([tuple(edit[c] for c in COLUMNS)], LOG)), branches, "b", "main", blobs, "m", 700, 90, 3000)
    assert sorted((r["file_id"], r["kind"], r["path"]) for r in last.collect()) == sorted([(f, "rename", "elsewhere"), ("b", "merge", None)])


def test_sweeps_equal_every_request_by_itself(spark):
    rng = random.Random(6)
    rows = [(f"r{n}", f"s{rng.randrange(3)}", n, rng.randrange(400), rng.randrange(90), rng.choice(["main", "b"])) for n in range(300)]
    log = spark.createDataFrame(rows, "id string, site_id string, lamport long, seq long, ts long, branch_id string")
    branches = spark.createDataFrame([("b", "b", "main", {"s0": 200, "s1": 90}, 1, 1, False)], BRANCH_RECORD)
    asked = [(i, rng.choice(["main", "b", "lost"]), rng.choice([None, -5, 200, *range(0, 90, 7)])) for i in range(60)]
    sees = lambda r, b: r[5] == b or b == "b" and r[3] <= {"s0": 200, "s1": 90}.get(r[1], -1)
    vectors, points = set(), set()
    for i, b, t in asked:
        mine = [r for r in rows if b != "lost" and sees(r, b) and (t is None or r[4] <= t)]
        vectors |= {(i, s, max(r[3] for r in mine if r[1] == s)) for s in {r[1] for r in mine}}
        points.add((i, max((r[2] for r in mine), default=None) if t is not None else None))
    requests = spark.createDataFrame(asked, "request long, branch_id string, t long")
    for stretch in (7, 1_000_000):
        assert {tuple(r) for r in br.fork_vectors(log, branches, requests, stretch).collect()} == vectors
        assert {tuple(r) for r in br.tag_points(log, branches, requests, stretch).collect()} == points


def test_tags_show_what_their_branches_were(spark):
    """Files whose ts fall in fold order, and files whose ts do not: the state of each tag equals the fold of its rows."""
    rows, contents, fork = two_branches(11)
    rng = random.Random(2)
    rows = [{**r, "ts": r["ts"] - (40 if r["file_id"] in ("f1", "f2", "f3") and rng.random() < 0.4 else 0)} for r in rows]
    log = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], LOG)
    blobs = spark.createDataFrame(list(contents.items()), "content_hash string, text string")
    branches = spark.createDataFrame([("b", "b", "main", {"s": fork}, fork, fork, False)], BRANCH_RECORD)
    tags = [("t1", "main", 30), ("t2", "main", 150), ("t3", "b", 150), ("t4", "b", 400), ("t5", "main", -1), ("t6", "main", 150)]
    got = {tuple(r) for r in tt.state_at_tags(log, spark.createDataFrame(tags, "tag_id string, branch_id string, at_ts long"), blobs, branches).collect()}
    want = set()
    for tag, branch, t in tags:
        seen = [r for r in rows if (r["branch_id"] == branch or branch == "b" and r["seq"] <= fork) and r["ts"] <= t]
        states = machine(seen, contents)
        named = resolved(states)
        want |= {(tag, f, named[f], s["hash"]) for f, s in states.items() if not s["deleted"]}
    assert got == want


def test_search_in_blocks_equals_one_block(spark):
    rows = [(k, [float((k * j) % 7 - 3) for j in range(1, 5)]) for k in range(60)] + [(60, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    queries = vectors.filter("id % 5 = 0").withColumnRenamed("id", "query")
    key = lambda df: sorted((r["query"], r["rank"], r["id"]) for r in df.collect())
    one = key(misc.search(vectors, queries, 4))
    assert one == key(misc.search(vectors, queries, 4, block=3)) and len(one) == 13 * 4

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 12) if n else -9.0

    held = dict(rows)
    for q in (5, 35):
        want = sorted((i for i in held if i != q), key=lambda i: (-cosine(held[q], held[i]), i))[:4]
        assert [i for x, _, i in one if x == q] == want
    assert misc.search(vectors, queries.limit(0), 4).isEmpty()
