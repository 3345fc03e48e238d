"""Alignments against brute force, and merges of whole tables against the merge of one triple."""

from __future__ import annotations

import random
import time

import pytest

from chronofold.operators import merge


def longest(a: list[str], b: list[str]) -> int:
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            d[i][j] = d[i + 1][j + 1] + 1 if a[i] == b[j] else max(d[i + 1][j], d[i][j + 1])
    return d[0][0]


def lines(rng: random.Random, values: int, most: int = 12) -> list[str]:
    return [str(rng.randrange(values)) for _ in range(rng.randrange(most))]


@pytest.mark.parametrize("align", [merge.few_edits, merge.many_edits, lambda a, b: sorted(merge.line_pairs(a, b).items())])
def test_alignments_are_longest(align):
    rng = random.Random(2)
    for _ in range(20_000):
        values = rng.choice([2, 3, 8])
        a, b = lines(rng, values), lines(rng, values)
        pairs = align(a, b)
        assert len(pairs) == longest(a, b), (a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("values", [50, 5_000, 10**9])
def test_long_texts_align_in_seconds(values):
    rng = random.Random(3)
    a, b = ([str(rng.randrange(values)) for _ in range(10_000)] for _ in range(2))
    began = time.perf_counter()
    merge.line_pairs(a, b)
    assert time.perf_counter() - began < 20


def test_identities():
    """Sides that agree or did not change, in every class; a merge of one side with itself is that side."""
    rng = random.Random(4)
    for _ in range(2_000):
        base, ours, theirs = ("".join(f"{x}\n" for x in lines(rng, 8)) for _ in range(3))
        for kind in ("text", "code", "binary"):
            assert merge.merge_text(kind, base, ours, ours)[0] == ours
            assert merge.merge_text(kind, base, base, theirs) == (theirs, False)
            if kind != "binary":
                assert merge.merge_text(kind, base, ours, base) == (ours, False)


def test_tables_merge_like_single_triples(spark):
    rng = random.Random(5)
    triples = []
    for k in range(3_000):
        base = lines(rng, rng.choice([3, 8, 1000]), 14)
        sides = []
        for _ in range(2):
            side = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(side) + 1)
                side[at : at + rng.randrange(3)] = [rng.choice("xyz0") for _ in range(rng.randrange(3))]
            sides.append(side)
        end = [rng.choice(["\n", ""]) for _ in range(3)]
        texts = ["\n".join(x) + e if x else "" for x, e in zip((base, *sides), end, strict=True)]
        if k % 50 == 0:
            texts[rng.randrange(3)] += "\0"
        triples.append((k, rng.choice(["text", "code", "binary"]), *texts))
    got = {r["key"]: (r["merged"], r["conflict"]) for r in merge.merge3(spark.createDataFrame(triples, "key long, merge_class string, base string, ours string, theirs string")).collect()}
    same = lambda b, o, t: o == t or t == b or o == b
    for k, kind, *texts in triples:
        merged, conflict = merge.merge_text(kind, *texts)
        if kind == "binary" and same(*texts):
            conflict = False
        assert got[k] == (merged, conflict) or same(*texts) and kind != "binary" and got[k][1] is False, (kind, texts, got[k], merged)


def test_one_run_each_needs_no_python(spark):
    base = "".join(f"{k}\n" for k in range(40))
    rows = [(k, "code", base, base.replace("3\n4\n", "ours\n", 1), base.replace("\n37\n", "\ntheirs\nmore\n")) for k in range(20)]
    done = merge.merge3(spark.createDataFrame(rows, "key long, merge_class string, base string, ours string, theirs string"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    for k, kind, *texts in rows:
        assert next((r["merged"], r["conflict"]) for r in done.collect() if r["key"] == k) == merge.merge_text(kind, *texts)
        break


def test_lines_are_split_once_a_text(spark):
    """Splits named again for every use would grow a merge's plan, and its time, many times over."""
    kind = "key long, merge_class string, base string, ours string, theirs string"
    rows = [(k, "code", f"a\nb\nc\n{k}", f"x\nb\nc\n{k}", f"a\nb\nz\n{k}") for k in range(3)]
    done = merge.merge3(spark.createDataFrame(rows, kind))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 3
    assert sorted((r["key"], r["merged"], r["conflict"]) for r in done.collect()) == [(k, f"x\nb\nz\n{k}", False) for k in range(3)]


def test_ends_without_a_line_break(spark):
    """A last line without a break is another line than one with it; every short triple, natively or not, merges like itself."""
    texts = ["", "a", "a\n", "a\nb", "a\nb\n", "a\nb\nc", "a\nb\nc\n", "x\nb\nc", "a\nb\ny", "a\nb\ny\n", "\n", "a\n\n"]
    triples = [(0, "text", b, o, t) for b in texts for o in texts for t in texts if len({b, o, t}) == 3]
    triples = [(k, *x[1:]) for k, x in enumerate(triples)]
    got = merge.merge3(spark.createDataFrame(triples, "key long, merge_class string, base string, ours string, theirs string")).collect()
    assert {r["key"]: (r["merged"], r["conflict"]) for r in got} == {k: merge.merge_text(*x) for k, *x in triples}
