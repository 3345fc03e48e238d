"""Vector search, ranked text search and the prefix trie against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import crosspolytope, hybridrank, prefixtrie

# --- vectors ----------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, query_id long, rank int, score double"


def brute(rows: list[tuple], every: int, k: int) -> dict[int, list[tuple[int, float]]]:
    """The k nearest of each asked row, over the rows that take part."""
    sizes = Counter(len(v) for i, v in rows if fit(i, v))
    dim = max(sizes, key=lambda n: (sizes[n], n), default=0)
    best: dict[int, tuple] = {}
    for i, v in rows:
        if fit(i, v) and len(v) == dim:
            v = tuple(float(np.float32(x)) for x in v)
            best[i] = min(best.get(i, v), v)
    dot = lambda a, b: float((np.array(a) * np.array(b)).sum())
    return {q: sorted(((i, dot(best[q], v)) for i, v in best.items() if i != q), key=lambda x: (-x[1], x[0]))[:k] for q in best if q % every == 0}


def fit(i: int | None, v: list | None) -> bool:
    return i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def search(spark, rows: list[tuple], every: int = 5, k: int = 4, **more) -> dict[int, list[tuple[int, float]]]:
    df = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], VECTORS).repartition(3)
    out: dict[int, list] = {}
    for r in sorted(crosspolytope.nearest(df, F.col("vec_id") % every == 0, k, **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_vectors_with_awkward_rows_and_ties(spark):
    """With probes for every neighbour of every query the search is exact: small whole numbers, so that many scores are equal."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # a group of copies beyond k
    rows += [(300, None), (305, [0.0] * 6), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (315, [float("nan")] * 6), (320, [float("inf")] + [0.0] * 5), (325, [1.0, 2.0]), (None, [1.0] * 6)]
    rows += [rows[3], (10, [9.0] * 6), (10, [-9.0] * 6)]  # a repeated row, and one id with several vectors
    want = {q: [(i, pytest.approx(s)) for i, s in x] for q, x in brute(rows, 5, 4).items()}
    assert search(spark, rows, target=1.0, sample=10_000) == want


def test_few_or_no_vectors(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0, 0.0])]) == {}
    assert search(spark, [(0, [1.0, 0.0]), (7, [0.0, 1.0])]) == {0: [(7, 0.0)]}
    assert search(spark, [(3, [1.0]), (4, [2.0])]) == {}


@pytest.mark.parametrize("crowd", [512, 4])
def test_recall_and_lengths(spark, monkeypatch, crowd):
    """Vectors of very different lengths, with one rotation and with two."""
    monkeypatch.setattr(crosspolytope, "CROWD", crowd)
    rng = np.random.default_rng(3)
    rows = [(i, (v * rng.choice([0.1, 1.0, 4.0])).tolist()) for i, v in enumerate(rng.standard_normal((1500, 24)))]
    rows += [(2000 + i, (np.ones(24) + rng.standard_normal(24) / 50).tolist()) for i in range(300)]  # a dense group
    found, want = search(spark, rows, 20, 10), brute(rows, 20, 10)
    assert found.keys() == want.keys()
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    assert all(s == pytest.approx(dict(brute_all(rows, q))[i]) for q in list(want)[:20] for i, s in found[q])


def brute_all(rows: list[tuple], q: int) -> list[tuple[int, float]]:
    own = np.float32(dict(rows)[q]).astype(float)
    return [(i, float(own @ np.float32(v).astype(float))) for i, v in rows]


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Queries and rows of one bucket dealt over many blocks give what one block gives."""
    monkeypatch.setattr(crosspolytope, "HELD", 3)
    monkeypatch.setattr(crosspolytope, "CHUNK", 7)
    rng = np.random.default_rng(9)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) / 9).tolist()) for i in range(90)]
    found = search(spark, rows, 3, 5, target=1.0, sample=10_000)
    assert found == {q: [(i, pytest.approx(s)) for i, s in x] for q, x in brute(rows, 3, 5).items()}


def test_hadamard_and_probe_order():
    x = np.random.default_rng(1).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(crosspolytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(crosspolytope.hadamard(crosspolytope.hadamard(x)), x)
    for second in (0, 2, 8):
        t = crosspolytope.Tables(12, 3.0, 4, second)
        rows = np.random.default_rng(2).standard_normal((40, 12)) / 4
        units = t.units(rows, query=True)
        probes = t.probes(units, t.buckets)
        assert all(len(set(p)) == t.buckets for p in probes.reshape(-1, t.buckets).tolist())
        places = t.places(units[0], t.units(rows))
        keys = t.keys(t.units(rows))
        for r in range(40):
            for j in range(4):
                assert probes[0, j, places[r, j]] == keys[r, j]


# --- ranking ----------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text: str | None) -> list[str]:
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def rank_all(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    n_docs, length = len(bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, w in bags:
            tf = Counter(w)
            m = 100 - 90 + (90 * len(w) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in wanted if tf[t])
            scored += [(i, s)] * (s > 0)
        scored.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, r + 1, i, s) for r, (i, s) in enumerate(scored[:k])]
    return out


ITEMS = "item_id long, text string, rank int, doc_id long, score double"


def ranking(spark, docs, items: list[tuple], **more) -> list[tuple]:
    asked = spark.createDataFrame([(i, t, 7, 7, 0.0) for i, t in items], ITEMS)
    return sorted(tuple(r) for r in hybridrank.search(docs, asked, **more).collect())


def test_ranking_equals_brute_force(spark, docs, rows, monkeypatch):
    pairs = [(r[0], r[1]) for r in rows]
    texts = [t for _, t in pairs if t]
    items = [(1, texts[0][:200]), (2, texts[3][50:400]), (3, None), (4, ""), (5, "zzz nowhere"), (6, "THE of"), (7, texts[2][:90]), (7, texts[5][:90]), (None, "the"), (8, texts[-1][:300])]
    want = sorted(rank_all(pairs, items, 10))
    assert ranking(spark, docs, items) == want
    assert ranking(spark, docs, items, block_bytes=300) == want  # several passes
    monkeypatch.setattr(hybridrank, "BLOCK_DOCS", 4)
    assert ranking(spark, docs, items, k=3) == sorted(rank_all(pairs, items, 3))


def test_ranking_of_nothing(spark, docs, no_docs):
    assert ranking(spark, no_docs, [(1, "the")]) == []
    assert ranking(spark, docs, []) == []


@pytest.mark.parametrize("share", [0.0, 1 / 16, 0.3, 2.0])
def test_skipping_loses_nothing(share):
    """Any share of short lists and any stride, so many equal scores as can be: the same as summing every list."""
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 60)
        docs = [Counter(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
        weights = np.array([rng.randrange(0, 4) for _ in range(8)], dtype=np.int64)
        sizes = np.array([len(d) for d in docs])
        flat = [("abcdefgh".index(t), f) for d in docs for t, f in sorted(d.items())]
        lengths = np.array([sum(d.values()) for d in docs])
        block = hybridrank.Block(list(range(n)), lengths, sizes, np.array([t for t, _ in flat]), np.array([f for _, f in flat]), weights, n, int(lengths.sum()))
        query = np.array(sorted(rng.sample(range(8), rng.randrange(1, 8))))
        best = hybridrank.Best(3)
        block.search(query, best, share, rng.choice([1, 5, 100]))
        sums = np.zeros(n, dtype=np.int64)
        for t in query:
            if int(t) in block.place:
                i = block.place[int(t)]
                sums[block.doc[block.first[i] : block.end[i]]] += block.score[block.first[i] : block.end[i]]
        want = sorted(((-s, d) for d, s in enumerate(sums.tolist()) if s > 0))[:3]
        assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want


# --- prefix trie --------------------------------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, depth long, node string"


def trie_rows(rows: list[tuple]) -> list[tuple]:
    """The trie by its definition: every prefix of every rebuilt conversation."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + t[h:])
    members: dict[tuple, list[int]] = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = sum(1 for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in under))
        tokens = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(m) if full[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), leaves, tokens, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk() -> list[tuple]:
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 30), *range(100, 140), *range(205, 215), 1_000_000_007]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "ab", "", None, "é" * 3])))
    rows += [(300, 0, "user", "x"), (300, 0, "user", "y"), (300, None, "user", "first"), (300, 1, "user", "z"), (300, 1, "user", "z"), (None, 0, "user", "nobody")]
    rows += [(301, k, "user", "long" if k % 2 else "er") for k in range(40)] + [(302, k, "user", "long" if k % 2 else "er") for k in range(55)]
    return rows


@pytest.mark.parametrize(("most", "step"), [(400_000, 50_000), (40, 7), (1, 3)])
def test_trie_equals_its_definition(spark, most, step):
    rows = talk()
    df = spark.createDataFrame([(*r, 9, "n") for r in rows], TALK).repartition(3)
    assert sorted((tuple(r) for r in prefixtrie.nodes(df, most, step).collect()), key=str) == trie_rows(rows)


def test_trie_of_nothing(spark):
    assert prefixtrie.nodes(spark.createDataFrame([], TALK)).collect() == []
    assert prefixtrie.nodes(spark.createDataFrame([(None, 1, "user", "x", 1, "n")], TALK)).collect() == []


def test_exit_nodes_and_handles():
    """Random sequences over few turns: each is found where a walk from the root leaves the trie, and handles are exact."""
    rng = random.Random(12)
    for _ in range(150):
        trie, paths = prefixtrie.ZFastTrie(), []
        for c in range(rng.randrange(1, 30)):
            path, prefix = [], prefixtrie.ROOT
            for _ in range(rng.randrange(0, 25)):
                prefix = prefixtrie.below(prefix, bytes([rng.choice([0, 0, 0, 1])]))
                path.append(prefix)
            known = max((d for d in range(len(path) + 1) if d == 0 or any(len(p) >= d and p[d - 1] == path[d - 1] for p in paths)), default=0)
            node = trie.exit_node(path)
            assert node.above <= known <= node.depth and (node is trie.root or node.path[node.above] == path[node.above])
            trie.insert([(c, path, [1] * len(path))])
            paths.append(path)
        assert all(trie.handles[n.handle()] is n for n in trie.handles.values())
        rows = list(trie.expand())
        assert len({r[0] for r in rows}) == len(rows) == len({p[d - 1] for p in paths for d in range(1, len(p) + 1)}) + 1
        for row in rows:
            inside = [c for c, p in enumerate(paths) if row[2] == 0 or len(p) >= row[2] and p[row[2] - 1] == row[0]]
            assert (row[4], row[5], row[6]) == (min(inside), len(inside), sum(len(paths[c]) == row[2] for c in inside))


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 70):
            f = prefixtrie.two_fattest(low, high)
            assert low < f <= high and max((x & -x) for x in range(low + 1, high + 1)) == f & -f
