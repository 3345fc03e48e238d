"""Near duplicates, components, repeated substrings and their suffix sorting against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from chronofold.llm import graph, neardup, substrings, suffixes
from chronofold.llm.hashing import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(t, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    n = min(width, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def grouped(rows, width):
    """doc_id -> component, all pairs compared; rows of one id are one node."""
    own = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(sets(r[1], width))
    parent = {i: i for i in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in own:
        for b in own:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in own[a] for y in own[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in own}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, no_docs, width):
    want = grouped(rows, width)
    got = neardup.near_duplicates(docs, width=width).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter((r[0], len(sets(r[1], width))) for r in rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    lone = [r for r in got if r["doc_id"] is None]
    assert sorted((r["component_id"] is None, r["kept"]) for r in lone) == [(False, False), (True, True)]
    if width == 2:
        assert neardup.near_duplicates(no_docs).count() == 0


def test_a_doc_id_on_several_texts_has_the_links_of_all(spark):
    """Any order of the rows gives the same components, which join what any of a document's texts is linked with."""
    rng = random.Random(17)
    bases = [[f"b{j}w{i}" for i in range(60)] for j in range(70)]
    rows = []
    for i in range(90):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"n{rng.randrange(10**9)}"
        rows.append((rng.randrange(75), " ".join(words)))
    rows += [(3, ""), (200, None), (200, rows[0][1]), (None, rows[1][1])]
    want = grouped(rows, 2)
    assert len({r[0] for r in rows}) < len(rows) - 20 and len(set(want.values())) > 3
    for _ in range(2):
        rng.shuffle(rows)
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=2).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())


def test_many_near_copies_in_chains(spark):
    """Copies that drift apart: far ones link over others only."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        if i % 3 == 0:
            words[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join([*words[: rng.randrange(110, 120)], rng.choice("ab")])))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == grouped(rows, 2)


def test_odd_sketch_estimates():
    sampler = neardup.Sampler(neardup.BANDS, neardup.ROWS, neardup.BITS)
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.97):
        x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        k = int(2000 * 2 * share / (1 + share))
        y = np.concatenate([x[:k], rng.integers(0, 1 << 63, 2000 - k, dtype=np.uint64)])
        a, b = sampler(x)[1], sampler(y)[1]
        differ = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64).tolist())
        guess = 1 + neardup.BITS / (4 * neardup.BANDS * neardup.ROWS) * np.log(1 - 2 * differ / neardup.BITS)
        assert abs(guess - share) < 0.1


def test_word_hashes_follow_words():
    a, b = word_hashes("The  CAT\tsat\nDÉJÀ"), word_hashes("the cat SAT déjà")
    assert list(a[:3]) == list(b[:3]) and a[3] != b[3]  # only A-Z fold
    assert len(word_hashes("")) == len(word_hashes(" \n\x0b")) == 0
    assert len(word_hashes("a\xa0b c")) == 2


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)] + [(5, 5), (None, 4)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows, least):
    datas = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(d[k : k + least] for d in datas for k in range(len(d) - least + 1))
    out = []
    for r, d in zip(rows, datas, strict=True):
        gone = np.zeros(len(d) + 1, dtype=bool)
        for k in range(len(d) - least + 1):
            if count[d[k : k + least]] > 1:
                gone[k : k + least] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(d) else 0
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~gone[:-1]]) if d else b""
        out.append((r[0], len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("least,gram", [(200, 64), (60, 20)])
def test_repeated_substrings(docs, rows, no_docs, least, gram):
    got = substrings.report(docs, least, gram).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(removed(rows, least))
    if least == 200:
        assert substrings.report(no_docs).count() == 0


def test_frequent_grams_are_split(spark, monkeypatch):
    """A short passage in every text, with like and unlike surroundings: split groups give the same as whole ones."""
    monkeypatch.setattr(substrings, "GROUP", 3)
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, sides = letters(90), [letters(150) for _ in range(6)]
    rows = [(i, letters(40) + rng.choice(sides)[rng.randrange(140) :] + core + rng.choice(sides)[: rng.randrange(150)] + letters(60)) for i in range(70)]
    rows += [(100 + i, letters(30) + sides[0][-100:] + core + sides[1][:80] + letters(25)) for i in range(9)]
    got = substrings.report(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(removed(rows, 200))


def test_links_in_a_large_mixed_bucket(spark, monkeypatch):
    """Copies of one text with few to many edits: all links of 0.80 to 0.85 are found, in blocks of the bucket."""
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "NEIGHBOURHOOD", 50)
    monkeypatch.setattr(neardup, "AT_PIVOT", 30)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8, 12, 20, 40])):
            words[rng.randrange(150)] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    twins = []
    for i in range(40):  # pairs of 0.80 to 0.85 whose members are far from the rest
        words = list(base)
        for _ in range(25):
            words[rng.randrange(150)] = f"m{i}-{rng.randrange(10**6)}"
        other = list(words)
        for k in rng.sample(range(0, 150, 4), 7):
            other[k] = f"o{i}-{k}"
        twins.append((1000 + 2 * i, 1001 + 2 * i))
        rows += [(twins[-1][0], " ".join(words)), (twins[-1][1], " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    want = grouped(rows, 2)
    assert sum(want[a] == want[b] for a, b in twins) > 20
    assert got == want


def test_cleaned_keeps_columns_and_characters(docs, rows):
    got = substrings.cleaned(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes and got.count() == len(rows)
    for r in got.collect():
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    assert got.filter("text is null").count() == sum(r[1] is None for r in rows)


def test_deep_shallow_sorts():
    rng = random.Random(3)
    for _ in range(200):
        s = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(0, 30))]
        assert [s[i] for i in suffixes.deep_shallow(s, 0, rng.randrange(0, 8))] == sorted(s)


def test_reaches_equal_all_pairs():
    rng = random.Random(4)
    for _ in range(300):
        m, least = rng.randrange(1, 14), rng.randrange(2, 14)
        left, right = ([bytes(rng.choice(b"aaab") for _ in range(rng.randrange(12))) for _ in range(m)] for _ in range(2))
        want = []
        for i in range(m):
            best = (0, 0)
            for j in range(m):
                a, b = suffixes.lcp(left[i], left[j]), suffixes.lcp(right[i], right[j])
                if i != j and a + b >= least:
                    best = (max(best[0], a), max(best[1], b))
            want.append(best)
        assert suffixes.reaches(left, right, least) == want


def test_every_repeat_has_an_anchor():
    rng = random.Random(5)
    shared = bytes(rng.randrange(97, 123) for _ in range(90))
    for _ in range(50):
        a = bytes(rng.randrange(97, 123) for _ in range(rng.randrange(100))) + shared + b"q" * rng.randrange(60)
        b = b"zz" * rng.randrange(80) + shared + bytes(rng.randrange(97, 123) for _ in range(rng.randrange(50)))
        at = [{(p - x.index(shared), h) for p, h in zip(*substrings.anchors(x, 60, 20)[:2], strict=True)} for x in (a, b)]
        for k in range(len(shared) - 60 + 1):
            assert any(k <= p <= k + 40 for p, _ in at[0] & at[1]), k
