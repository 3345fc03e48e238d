"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_dedup import grouped


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{base}/documents.parquet")
    words = rows[2][1].split()
    spark.createDataFrame([(1, " ".join(words[5:25])), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.example.com/en/3", "<html lang=en>")], "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    return str(base)


def test_stages(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    plain = [(r[0], r[1]) for r in rows]
    out = pipeline.saved(pipeline.language_stage(spark, docs, folder))
    assert out.columns == names
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert set(kept) <= set(plain) and all(x in kept for x in plain if x[1] and len(x[1].split()) > 20 and x[0] is not None and x[0] < 14)
    near = pipeline.saved(pipeline.near_duplicate_stage(spark, out, folder))
    want = grouped(kept, 5)
    assert near.columns == names
    assert {r["doc_id"] for r in near.collect() if r["doc_id"] is not None} == {d for d, c in want.items() if d == c}
    cut = pipeline.saved(pipeline.substring_stage(spark, near, folder))
    assert cut.columns == names and cut.count() == near.count()
    long = [r["text"].encode() for r in cut.collect() if r["text"]]
    seen = collections.Counter(x[k : k + 220] for x in long for k in range(len(x) - 219))
    assert all(n == 1 for n in seen.values())  # a cut may join what was apart, but no long passage is left twice
    clean = pipeline.saved(pipeline.decontamination_stage(spark, cut, folder))
    assert 2 not in {r["doc_id"] for r in clean.collect()} and clean.count() >= cut.count() - 2
    packed = pipeline.saved(pipeline.packing_stage(spark, clean, folder))
    assert packed.agg({"length": "sum"}).first()[0] > 0
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}


def test_verdicts_take_effect_row_by_row(spark, folder, rows):
    texts = [r[1] for r in rows]
    bad, near = texts[2], texts[0].split(" ")
    near[20] = "OTHER"
    own = [(None, bad), (7, bad), (7, texts[6]), (None, texts[0]), (None, " ".join(near)), (50, texts[0]), (40, texts[0]), (None, texts[8]), (None, texts[8]), (None, None), (None, None), (None, "  "), (None, texts[10])]
    docs = spark.createDataFrame([(d, x, "en", None, None) for d, x in own], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    count = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert count(pipeline.decontamination_stage(spark, docs, folder)) == collections.Counter(x for x in own if x[1] != bad)
    left = count(pipeline.near_duplicate_stage(spark, docs, folder))
    assert left == collections.Counter([(7, bad), (7, texts[6]), (40, texts[0]), (None, texts[8]), (None, None), (None, "  "), (None, texts[10])])
    alien = "日本語の文章です" * 40
    more = [(60 + i, texts[i], "en", None, None) for i in range(14)] + [(60, alien, None, None, None), (None, alien, None, None, None)]
    judged = count(pipeline.language_stage(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), folder))
    assert judged == collections.Counter([*(x for x in own if x[1] and x[1].strip()), *((60 + i, texts[i]) for i in range(14))])


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 0
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "packing"]


def test_stages_leave_no_copies_of_the_corpus(spark, folder, rows, tmp_path_factory, monkeypatch):
    """What stays in the shared folder: the keys of dropped rows, or a stage's result; of a run its last result alone."""
    own = [*rows, rows[20], (None, "  ", None, None, None, None, None, None, None), (None, "  ", None, None, None, None, None, None, None)]
    at = tmp_path_factory.mktemp("read") / "docs"
    docs = spark.createDataFrame([r[:5] for r in own], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(at))
    shared = tmp_path_factory.mktemp("left")
    monkeypatch.setattr("chronofold.llm.common.shared_dir", lambda spark, n=iter(range(10**6)): f"file://{shared}/chronofold-{next(n)}-of-test")
    count = lambda df: collections.Counter(map(tuple, df.collect()))
    for stage in (pipeline.language_stage, pipeline.near_duplicate_stage, pipeline.decontamination_stage):
        read = spark.read.parquet(str(at))
        before = set(shared.iterdir())
        got = stage(spark, read, folder)
        left = [p for p in shared.iterdir() if p not in before]
        assert [spark.read.parquet(str(p)).columns for p in left] == [[pipeline.ROW]]
        # any other frame, here one whose rows stand in no file each, is copied with its keys, and gives the same
        assert count(got) == count(stage(spark, read.unionByName(read.limit(0)), folder)) and got.columns == read.columns
        assert 0 < sum(count(got).values()) < len(own)
    before = set(shared.iterdir())
    out = pipeline.run(spark, folder)
    left = [p for p in shared.iterdir() if p not in before]
    assert out.count() > 0 and len(left) == 1 and all(f"/{left[0].name}/" in f for f in out.inputFiles())


def test_keys_of_rows_read_and_made(spark, folder):
    read = spark.read.parquet(f"{folder}/documents.parquet")
    twice = read.crossJoin(spark.range(2))  # each row of a file twice
    for docs, copied in ((read, False), (twice, True), (read.filter("doc_id > 3"), True), (read.limit(5), True)):
        rows = pipeline.keyed(docs)
        assert pipeline.is_written(docs) != copied and rows.columns == [*docs.columns, pipeline.ROW]
        first, again = ({r[pipeline.ROW]: r["text"] for r in x.collect()} for x in (rows, rows.repartition(7)))
        assert first == again and len(first) == docs.count() and None not in first
