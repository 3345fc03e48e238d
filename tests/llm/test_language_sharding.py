"""Language identification and sharding."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import language, sharding

WORDS = {"en": "the of and house with river thing".split(), "de": "der und nicht haus über schön fluß".split(), "fr": "le été avec maison où rivière chose".split()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs, pages = [], []
    for i in range(300):
        code = rng.choice(["en", "en", "de", "fr"])
        docs.append((i, " ".join(rng.choice(WORDS[code]) for _ in range(rng.randrange(3, 60))), code, f"src{i % 3}", i))
        if i % 2:
            pages.append((i, f"https://www.h{code}.example.{'de' if code == 'de' else 'com'}/{code}/{i}.html?x=1", f'<html lang="{code}"><body>'))
    # a text that fits no language better than another: the page decides
    docs += [(500, "x", None, "src1", 1), (501, "x", None, None, 1), (502, None, "en", None, 1), (503, "", None, "src0", 1), (504, "日本語の文章です" * 40, "en", "src0", 1), (505, "river " * 20_000, "en", "src1", 1), (None, "the river", "en", None, 1)]
    docs.append(docs[0])
    pages += [(900, "http://hde.example.de/de/500", "<HTML LANG=de>"), (901, "http://hde.example.de/de/500/", "<html>"), (902, None, None), (903, "junk", "<html lang='fr'>")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, host long"), spark.createDataFrame(pages, "page_id long, url string, html string"), docs


def test_languages_by_all_evidence(corpus):
    docs, pages, rows = corpus
    got = language.identify(docs, pages).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    right = sum(by[r[0]]["lang"] == r[2] for r in rows[:300])
    assert right >= 297
    assert all(by[i]["kept"] for i in range(300)) and by[505]["kept"]
    assert by[500]["lang"] == "de" and by[500]["declared"] == "de" and by[500]["suffix"] == "de"
    assert not by[502]["kept"] and not by[503]["kept"] and not by[504]["kept"]
    assert all(0 < r["posterior"] <= 1 for r in got)


def test_languages_without_pages_rows_or_labels(corpus, docs, no_docs, rows):
    own, pages, _ = corpus
    assert language.identify(own).count() == own.count()
    assert language.identify(own, pages.limit(0)).count() == own.count()
    assert language.identify(no_docs, pages).count() == 0
    assert language.identify(docs, pages).count() == len(rows)
    assert language.identify(docs.drop("lang").withColumn("lang", docs.text.substr(1, 0)).filter("false"), pages).count() == 0


def test_rare_languages_have_models_or_keep_their_label(spark):
    rng = random.Random(6)
    rare = {"fi": "talo ja joki jossa yötä kävelee metsä".split(), "pl": "dom oraz rzeka gdzie spacer łąka źródło".split(), "el": "σπίτι και ποτάμι με πράγμα".split()}
    said = lambda words: " ".join(rng.choice(words) for _ in range(40))
    docs = [(i, said(WORDS[["en", "de"][i % 2]]), ["en", "de"][i % 2], None) for i in range(2400)]
    docs += [(3000 + i, said(rare["fi"]), "fi", None) for i in range(6)]  # a quarter of a per cent
    docs += [(3100, said(rare["pl"]), "pl", None), (3101, said(rare["el"]), None, None), (3102, "", "pl", None), (3103, said(rare["el"]), None, None)]
    pages = [(1, "http://a.example/3101", "<!--" + "x" * 5000 + "--><html lang='el'>"), (2, "http://a.example/3000", f"<script>{'y' * 3000}</script><html lang=fi>")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    by = {r["doc_id"]: r for r in language.identify(d, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(by) == len(docs)
    assert all(by[i]["lang"] == docs[i][2] and by[i]["kept"] for i in range(2400))
    assert all((by[3000 + i]["text_lang"], by[3000 + i]["lang"], by[3000 + i]["kept"]) == ("fi", "fi", True) for i in range(6))
    assert (by[3100]["lang"], by[3100]["text_lang"], by[3100]["posterior"], by[3100]["kept"]) == ("pl", None, None, True)
    assert (by[3101]["declared"], by[3101]["lang"], by[3101]["kept"]) == ("el", "el", True) and by[3000]["declared"] == "fi"
    assert not by[3102]["kept"] and not by[3103]["kept"]


def test_languages_are_not_capped(spark):
    d = spark.createDataFrame([(5 * i + k, "a text", f"l{i}") for i in range(80) for k in range(5)] + [(None, "x", "zz")] * 9, "doc_id long, text string, lang string")
    assert language.declared_languages(d) == sorted(f"l{i}" for i in range(80))


def test_models_and_least_mean_count_every_labelled_row(spark):
    """More rows a language than any fixed number of them; what half of the rows say is known, whatever their ids' hashes."""
    rng = random.Random(14)
    odd = "kvrtz wqxj pfgbn zzrkd vjmqw".split()
    by_hash = [r[0] for r in spark.range(3000).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(by_hash[1500:])
    docs = [(i, " ".join(rng.choice(odd if i in late else WORDS["en"]) for _ in range(60)), "en", None) for i in range(3000)]
    docs += [(5000 + i, " ".join(rng.choice(WORDS["de"]) for _ in range(60)), "de", None) for i in range(20)]
    docs += [(None, "and thing", "en", None), (None, None, "en", None), (6000, None, "de", None), (6001, "nobody knows", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4)
    counts = np.zeros((1 << language.BITS, 2))
    for _, text, code, _ in docs:
        for k in language.gram_buckets(text or "") if code else []:
            counts[k, ["de", "en"].index(code)] += 1
    model = language.text_models(d, ["de", "en"])
    assert model == pytest.approx(np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * len(counts))), rel=1e-5)
    evidence = language.text_evidence(d, ["de", "en"], model, 300)
    means = sorted(r["mean"] for r in evidence.collect() if r["grams"] >= 200 and r["label"])
    assert language.least_mean(evidence, ["de", "en"]) == pytest.approx(means[-(-len(means) // 20) - 1] - 1.5, abs=0.0011)
    by = {r["doc_id"]: r for r in language.identify(d).collect()}
    assert len(means) > 2900 and all(by[i]["kept"] and by[i]["text_lang"] == "en" for i in range(3000))


def test_model_reads_letters_only():
    assert len(language.gram_buckets("")) == 0 and len(language.gram_buckets("123 !!")) == 0
    assert list(language.gram_buckets("ABC")) == list(language.gram_buckets("abc"))


def fill(shards, slots):
    """The rule restated: whole orders written out, then turns."""
    orders = [[(a + k * s) % slots for k in range(slots)] for a, s in (sharding.preference(x, slots) for x in shards)]
    table, at = {}, [0] * len(shards)
    while True:
        for i, order in enumerate(orders):
            while order[at[i]] in table:
                at[i] += 1
            table[order[at[i]]] = i
            if len(table) == slots:
                return [table[k] for k in range(slots)]


def test_table_is_filled_in_turns():
    shards = [f"s{i}" for i in range(7)]
    assert sharding.lookup(shards, 101) == fill(shards, 101)
    sizes = collections.Counter(sharding.lookup([f"s{i}" for i in range(100)], 10_007))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for bad in (dict(shards=[]), dict(shards=["a", "a"]), dict(shards=["a"], slots=100)):
        with pytest.raises(ValueError):
            sharding.lookup(**bad)


def test_few_keys_move_when_a_shard_goes():
    a = [f"s{i}" for i in range(20)]
    before, after = sharding.lookup(a, 10_007), sharding.lookup(a[:-1], 10_007)
    moved = sum(x != y for x, y in zip(before, after, strict=True) if x != 19)
    assert moved < 0.1 * 10_007


def test_every_row_is_placed(docs, rows, no_docs):
    shards = ["a", "b", "c"]
    got = sharding.place(docs, "doc_id", shards, 101).collect()
    assert collections.Counter(r["key"] for r in got) == collections.Counter(r[0] for r in rows)
    table = sharding.lookup(shards, 101)
    assert all(table[r["slot"]] == r["shard"] and shards[r["shard"]] == r["shard_name"] for r in got)
    assert len({(r["key"], r["shard"]) for r in got}) == len({r["key"] for r in got})
    assert sharding.place(no_docs, "doc_id", shards).count() == 0


def test_shards_are_written_whole(spark, docs, rows, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs.select("doc_id", "text"), "doc_id", ["a", "b"], path, 2, 101)
    back = spark.read.parquet(path)
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter((r[0], r[1]) for r in rows)


def test_written_shards_keep_columns_of_their_own_names(spark, tmp_path):
    rows = [(i, f"mine{i}", i % 3, i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, shard string, __part int, slot int")
    sharding.write_shards(frame, "doc_id", ["a", "b"], f"{tmp_path}/out", 2, 101)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(tuple(r[c] for c in frame.columns) for r in got.collect()) == rows
    want = {r["key"]: r["shard_name"] for r in sharding.place(frame, "doc_id", ["a", "b"], 101).collect()}
    assert {r["doc_id"]: r["_shard"] for r in got.collect()} == want


def test_fusion_equals_plain_bayes(spark):
    """Posteriors from likelihoods, declared language, suffix and host prior, against the same sums in Python."""
    rng, langs, weight = random.Random(13), ["de", "en", "fr"], 20.0
    rows = []
    for i in range(120):
        host = rng.choice([None, "a.x.de", "b.x.de", "c.y.fr", "d"])
        likelihood = [-rng.random() * 6 for _ in langs]
        likelihood[rng.randrange(3)] = 0.0
        rows.append((i, rng.choice([0, 5, 90]), likelihood, host, host and host.split(".", 1)[-1], host and host.rsplit(".", 1)[-1], rng.choice([None, "de", "fr", "xx"]), rng.random() < 0.1))
    frame = spark.createDataFrame(rows, "doc_id long, grams long, likelihood array<double>, host string, domain string, suffix string, declared string, unmodelled boolean")
    got = {r["doc_id"]: r["posterior"] for r in language.fused(frame, langs, weight).collect()}
    verdict = {r[0]: r[2].index(max(r[2])) if r[1] > 0 and not r[7] else None for r in rows}
    judged = [r for r in rows if verdict[r[0]] is not None]

    def counts(column: int, value: object) -> list[int]:
        return [sum(r[column] == value and verdict[r[0]] == k for r in judged) for k in range(3)]

    def smoothed(n: list[int], above: list[float]) -> list[float]:
        return [(x + weight * a) / (sum(n) + weight) for x, a in zip(n, above, strict=True)]

    top = [sum(verdict[r[0]] == k for r in judged) for k in range(3)]
    corpus = [(x + 1) / (sum(top) + 3) for x in top]
    for r in rows:
        prior = corpus
        if r[3] is not None and sum(counts(3, r[3])):
            prior = smoothed(counts(3, r[3]), smoothed(counts(4, r[4]), corpus))
        logs = [x + math.log(p) for x, p in zip(r[2], prior, strict=True)]
        for column in (6, 5):
            n, sizes = counts(column, r[column]), [sum(x[column] is not None and verdict[x[0]] == k for x in judged) for k in range(3)]
            if r[column] is not None and sum(n):
                logs = [x + math.log((c + weight * sum(n) / sum(sizes)) / (s + weight)) for x, c, s in zip(logs, n, sizes, strict=True)]
        each = [math.exp(x - max(logs)) for x in logs]
        assert got[r[0]] == pytest.approx([x / sum(each) for x in each]), r
