"""Toxicity, quality, decontamination and licenses against brute force on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from chronofold.llm import decontaminate, licenses, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def multiset(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_toxicity_learns_and_scores_every_row(spark):
    rng = random.Random(2)
    insults, stems = ["blorg", "snarf"], "zqwk"
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(["the", "of", "thing", "house", "river"]) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[5] = rng.choice(insults) if i % 8 else stems + rng.choice("abcdefgh") + "x"
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "blorg " * 20_000), (None, "blorg"), (1000, None)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(d, y).collect()
    assert len(got) == len(docs)
    held = [(r["score"], labels[r["doc_id"]][1]) for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 90 and all((s >= 0.7) == bool(t) for s, t in held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] < 0.5 for r in got if r["doc_id"] in (1000, 1001)} == {True}


def test_toxicity_grammar_weighs_context():
    scorer = toxicity.Scorer(toxicity.seed_lexicon())
    plain, aimed, negated, said = map(scorer.raw, ("what an idiot.", "you are an idiot.", "he is not an idiot.", "she said idiot."))
    assert negated < plain < aimed and said < plain
    assert scorer.raw("idiotic nothing") == 0 and scorer.raw("the river") == 0
    assert scorer.raw("kill you") > scorer.raw("kill time")


def whole_clauses(scorer, text):
    """The rule restated: every clause between two ends, all its words."""
    total = 0.0
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        state, weight = 0, 0.0
        for word in toxicity.WORD.findall(clause):
            symbol, own = scorer.lexicon.symbol(word.replace("'", ""))
            _, w, state = scorer.grammar.step(state, symbol)
            weight += w * (own if symbol == "I" else 1.0)
        total += min(weight, 3.0)
    return total


def test_toxicity_reads_long_clauses_whole():
    scorer = toxicity.Scorer(toxicity.seed_lexicon())
    far = "river of stone " * 300
    assert scorer.raw(f"she said {far} idiot.") == scorer.raw("she said idiot.")
    assert scorer.raw("idiot " * 1000) == 3.0
    rng = random.Random(3)
    texts = ["s" + "kill " * 81 + "idiot", *[f"{'a' * k} idiot {'b' * (1990 + k)} loser; you" for k in range(12)]]
    texts += ["".join(rng.choice(["river ", "skill ", "you ", "kill ", "idiot ", "she said ", "not ", *[far[: rng.randrange(900)], "; ", ".\n"][rng.random() < 0.1 :]]) for _ in range(200)) for _ in range(40)]
    for text in texts:
        assert abs(scorer.raw(text) - whole_clauses(scorer, text)) < 1e-9, text[:80]


def test_toxicity_without_labels(docs, no_docs, labels):
    none = labels.limit(0)
    assert toxicity.score(docs, none).count() == docs.count()
    assert toxicity.score(docs, labels).count() == docs.count()
    assert toxicity.score(no_docs, labels).count() == 0


def quality_base(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count, covered = collections.Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_counts(docs, rows, labels, no_docs):
    got = quality.judge(docs, labels)
    assert multiset(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == collections.Counter((r[0], *quality_base(r[1])) for r in rows)
    assert got.filter("base_failed and kept").count() == 0
    assert quality.judge(no_docs, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_windows_of_any_width(spark):
    text = "a b c a b c d e a b x x x x y z a b c d e"
    d, words = spark.createDataFrame([(1, text), (2, "a"), (3, None)], "doc_id long, text string"), text.split()
    for width in (1, 2, 3, 5):
        at = collections.defaultdict(list)
        for i in range(len(words) - width + 1):
            at[tuple(words[i : i + width])].append(i)
        hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(width)}
        got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measured(d, width).collect()}
        assert got == {1: len(hit), 2: 0, 3: 0}


def test_quality_ratio_tells_junk(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["river", "stone", "house", "walks", "over"]) for _ in range(40 + i)) for i in range(60)]
    bad = [" ".join(rng.choice("@@@ ### $$$ ^^^".split()) + str(rng.randrange(9)) for _ in range(40 + i)) for i in range(10)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    y = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.judge(d, y).filter("kept or base_failed").collect()}
    assert set(range(60)) <= kept and not kept & {i for i in range(60, 70) if not quality_base(bad[i - 60])[-1]}


def contamination(t, windows):
    w, hit, items = ALNUM.findall(low(t)), set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if own := windows.get(tuple(w[k : k + n])):
                hit.update(range(k, k + n))
                items |= own
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, rows, no_docs):
    t = [r[1] for r in rows]
    bench = [(1, " ".join(t[0].split()[3:30])), (2, t[27]), (3, "two   WORDS"), (4, None), (5, "!!"), (10, t[2][40:200]), (1, "one"), (None, "one"), (2, t[27])]
    table = spark.createDataFrame(bench, "item_id long, text string")
    windows: dict = {}
    for i, x in bench:
        w = ALNUM.findall(low(x))
        for k in range(max(0, len(w) - 9) or bool(w)) if i is not None else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = collections.Counter((r[0], *contamination(r[1], windows)) for r in rows)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert multiset(decontaminate.report(decontaminate.scan(docs, table)), *names) == want
    assert multiset(decontaminate.report(decontaminate.scan(docs, table, block_bytes=300)), *names) == want, "in blocks"
    assert decontaminate.scan(no_docs, table).count() == 0
    assert decontaminate.scan(docs, table.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_reports_longest_matches(spark):
    words = [f"w{i}" for i in range(60)]
    d = spark.createDataFrame([(1, " ".join(["x"] * 5 + words[10:40] + ["y"]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    (m,) = decontaminate.scan(d, b).first()["matches"]
    assert (m["item"], m["item_word"], m["word"], m["words"]) == ("7", 10, 5, 30)


def test_suffix_arrays_are_sorted_by_all_words():
    rng = np.random.default_rng(4)
    for least in (1, 3, 10):
        ids = rng.integers(0, 4, 600) * (rng.random(600) < 0.95)
        if least == 10:
            ids[100:400] = 1  # long repeats
        tail = lambda k: tuple(ids[k : next((e for e in range(k, len(ids)) if ids[e] == 0), len(ids))].tolist())
        want = sorted(tail(k) for k in range(len(ids)) if len(tail(k)) >= least)
        assert [tail(k) for k in decontaminate.suffix_array(ids, least)] == want


def test_decontamination_equals_brute_force_at_any_width(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) for _ in range(30)]
    bench = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40)))) for i in range(12)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(bench, "item_id long, text string")
    for width in (4, 15):
        windows: dict = {}
        for i, x in bench:
            w = x.split()
            for k in range(max(0, len(w) - width + 1) or bool(w)):
                windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
        got = {r["doc_id"]: (r["n_hit"], r["items"], [tuple(m) for m in r["matches"]]) for r in decontaminate.scan(d, b, width).collect()}
        for i, t in enumerate(texts):
            w, hit, items, found = t.split(), set(), set(), set()
            for window, own in windows.items():
                for k in range(len(w) - len(window) + 1):
                    if tuple(w[k : k + len(window)]) == window:
                        hit |= set(range(k, k + len(window)))
                        items |= own
            for j, x in bench:
                v = x.split()
                for a in range(len(w)):
                    for c in range(len(v)):
                        n = 0
                        while a + n < len(w) and c + n < len(v) and w[a + n] == v[c + n]:
                            n += 1
                        if n >= min(width, len(v)) and (not a or not c or w[a - 1] != v[c - 1]):
                            found.add((str(j), c, a, n))
            assert got[i] == (len(hit), sorted(items), sorted(found)), (width, i)


def phrases(t):
    w, found = ALNUM.findall(low(t)), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark, docs, rows, no_docs):
    extra = [(100, "GNU General  Public-License, gnu general public license! CC BY"), (101, "mit licenses MIT License"), (102, "ccby cc-by"), (103, "apache license\napache license " * 3000)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = licenses.labelled(licenses.scan(both))
    assert multiset(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == collections.Counter((r[0], *phrases(r[1])) for r in [*rows, *extra])
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(no_docs).count() == 0


def test_fuzzy_notices_within_bounded_edits():
    scanner = licenses.Scanner(licenses.notices())
    for n in licenses.notices():
        rng = random.Random(n.text)
        for edits in range(n.edits + 1):
            text = list(n.text)
            for _ in range(edits):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choice([[], ["q"], [text[k], "q"]])
            found = scanner.fuzzy("before it " + "".join(text) + " after")
            assert any(e <= n.edits for _, _, _, e in found), (n, edits)
    assert scanner.fuzzy("the license of the river is not under any terms") == []


def one_after_another(machines: list, word: str) -> tuple[str, float]:
    """Each transducer reads all that the one before it wrote."""
    total = 0.0
    for machine in machines:
        state, out = 0, ""
        for symbol in word:
            new, weight, state = machine.step(state, symbol)
            out, total = out + new, total + weight
        word = out
    return word, total


def test_the_composed_grammar_does_what_its_transducers_do_in_turn():
    machines = [toxicity.windowed("N", {"I": "i", "H": "h"}, 3), toxicity.reported(), toxicity.windowed("T", {"I": "A", "H": "K"}, 4), toxicity.weighing(toxicity.CLASS_WEIGHTS)]
    whole = toxicity.grammar()
    rng = random.Random(21)
    words = ["".join(p) for n in range(5) for p in itertools.product("IHTNR.", repeat=n)]
    words += ["".join(rng.choice("IHTNR..") for _ in range(rng.randrange(5, 40))) for _ in range(3_000)]
    for word in words:
        want, total = one_after_another(machines, word)
        state, got, weight = 0, "", 0.0
        for symbol in word:
            new, w, state = whole.step(state, symbol)
            got, weight = got + new, weight + w
        assert (got, pytest.approx(weight)) == (want, total), word


def test_each_transducer_follows_its_rule():
    """Negation reaches three words, an address four; reported speech holds to the end of the clause."""
    negate, aim, report = toxicity.windowed("N", {"I": "i"}, 3), toxicity.windowed("T", {"I": "A"}, 4), toxicity.reported()
    for gap in range(7):
        assert one_after_another([negate], "N" + "." * gap + "I")[0][-1] == ("i" if gap < 3 else "I")
        assert one_after_another([aim], "T" + "." * gap + "I")[0][-1] == ("A" if gap < 4 else "I")
        assert one_after_another([report], "R" + "." * gap + "I")[0][-1] == "r"
    assert one_after_another([report], "I.R")[0] == "I.R"
