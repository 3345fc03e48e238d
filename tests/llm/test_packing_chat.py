"""Packing and chat formatting: exact round trips and brute-force checks."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from chronofold.llm import packing, templates

RANKS, PATTERN, WHOLE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WHOLE)


def test_rank_file_gives_the_tokenizers_ids(rows):
    t, encode = tokenizer(), packing.rank_encoder(RANKS, PATTERN, WHOLE)
    odd = ["", "  a", "a  b   c\n d", "x \n y ", "\t q", "it's  'tis", "é　 z  z", "<|endoftext|> x", "a\x1c b", "  \x85 b", "日本語 テキスト", "🙂🙂 a", "\r\n\r\n"]
    rng = random.Random(1)
    odd += ["".join(rng.choice("ab 'sé\n\t<|>1日") for _ in range(40)) for _ in range(200)]
    for text in [r[1] or "" for r in rows] + odd:
        assert t.encode(text, add_special_tokens=False).ids == encode(text).tolist(), repr(text[:60])


@pytest.mark.parametrize("run", [" ", "\n", "\t ", "a"])
def test_long_runs_of_one_character(spark, run):
    """Two million spaces or line ends, which the rank file's splitter cannot take."""
    text = "a" + run * (2_000_000 // len(run)) + "b" if run != "a" else run * 300_000 + " <|endoftext|>"
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = packing.pack(docs, RANKS, PATTERN, WHOLE, digest=packing.piece_crc32, digest_type="long").collect()
    ids = tokenizer().encode(text, add_special_tokens=False).ids
    own = sorted((r["piece"], r["start"], r["length"], r["digest"]) for r in got if r["doc_id"] == 1)
    assert sum(x[2] for x in own) == len(ids) + 1
    assert all(zlib.crc32(np.array([*ids, 2][s : s + n], dtype="<u4").tobytes()) == c for _, s, n, c in own)


def test_added_tokens_are_those_of_the_unchanged_tokenizer(spark, tmp_path):
    from chronofold.llm import registry

    t, encode = tokenizer(), packing.rank_encoder(RANKS, PATTERN, WHOLE)
    rng = random.Random(7)
    odd = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>  y", "<|endoftext|><|endoftext|>", "<|endoftext|", "<|<|endoftext|>|>", "<|ENDOFTEXT|>"]
    odd += ["".join(rng.choice(["<|endoftext|>", " ", "  ", "it's", "\n", "é", "日", "<|", "|>", "ab"]) for _ in range(20)) for _ in range(200)]
    want = [t.encode(x, add_special_tokens=False).ids for x in odd]
    assert want[0] == [64, 220, 50256, 275]
    assert [encode(x).tolist() for x in odd] == want
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in registry.op3_packing(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], dtype="<u4").tobytes())) for i, x in enumerate(want)}


def test_every_document_is_packed_whole(docs, rows, no_docs):
    t = tokenizer()
    got = packing.pack(docs, RANKS, PATTERN, WHOLE, capacity=128, small=16, groups=8).collect()
    bins = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in got:
        assert r["length"] == len(r["digest"]) <= 128
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], tuple(r["digest"])))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    want = collections.Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    single = {d for d, n in collections.Counter(r[0] for r in rows).items() if n == 1}
    for doc, ids in want:
        if doc in single:
            own = sorted(pieces[doc])
            assert [p for p, _, _ in own] == list(range(len(own)))
            assert sum((x for _, _, x in own), ()) == ids
            assert [s for _, s, _ in own] == np.cumsum([0] + [len(x) for _, _, x in own[:-1]]).tolist()
            assert len(own) == 1 or all(len(x) == 128 for _, _, x in own[1:])
    assert sum(len(r["digest"]) for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack(no_docs, RANKS, PATTERN, WHOLE).count() == 0


def test_a_worker_builds_one_encoder_and_no_other_python_worker_starts(docs, monkeypatch):
    """Memory of an executor: few added tokens instead of the whole file go to tasks, an encoder is kept, small tables come by Arrow."""
    added = tuple(packing.added_tokens(WHOLE).items())
    text = "one<|endoftext|>two  three\n\n"
    encode = packing.rank_encoder(RANKS, PATTERN, "/no such file", added)
    assert packing.rank_encoder(RANKS, PATTERN, "/no such file", added) is encode
    assert encode(text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids
    given, create = [], SparkSession.createDataFrame
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **k: given.append(data) or create(self, data, *a, **k))
    assert packing.pack(docs, RANKS, PATTERN, WHOLE).count() >= docs.count()
    assert given and all(isinstance(x, pa.Table) for x in given)


@pytest.mark.parametrize("seed", range(40))
def test_plans_fill_sequences(seed):
    rng = random.Random(seed)
    hist = {rng.randrange(1, 1025): rng.randrange(1, 200) for _ in range(rng.randrange(1, 120))}
    runs = packing.plan(hist, 1024, 96, 24, 400)
    assert all(sum(c for n, _, c, _, _ in runs if n == length) == count for length, count in hist.items())
    sequences = collections.defaultdict(list)
    for n, _, count, first, offset in runs:
        for k in range(count):
            sequences[first + k].append((offset, n))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    greedy = packing.Bins()
    for n in sorted(hist, reverse=True):
        greedy.best_fit(1024, n, hist[n])
    assert len(sequences) <= greedy.next_sequence * 1.02 + 2


def test_digest_is_of_little_endian_ids():
    ids = np.array([1, 70_000], dtype="<u4")
    assert packing.piece_crc32(ids) == zlib.crc32((1).to_bytes(4, "little") + (70_000).to_bytes(4, "little"))


# --- chat ------------------------------------------------------------------------------------------------------------------


def render(source, messages):
    return list(templates.compiled(source)(messages))


def test_language():
    rows = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]
    source = "{% for m in messages %}{% if loop.first %}[{% elif loop.last and m.role != 'user' %}!{% else %}?{% endif %}{{ m.role + ':' + (m.text | upper) }}{% endfor %}]"
    assert "".join(t for t, _ in render(source, rows)) == "[user:A!assistant:B]"
    assert render("{% set x = 'q' + 'r' %}{{ x }}", []) == [("qr", False)]
    assert render("{% generation %}{{ 'a' }}{% endgeneration %}b", []) == [("a", True), ("b", False)]


def test_constants_fold():
    tree = templates.folded(templates.parse("a{{ 'b' + 'c' | upper }}{% if true and not false %}d{% else %}{{ x }}{% endif %}{% if 1 == 2 %}never{% endif %}e"))
    assert tree == (templates.Output(templates.Const("abCde")),)
    tree = templates.folded(templates.parse("{{ m.role + 'a' + 'b' }}"))
    assert tree == (templates.Output(templates.Op("+", (templates.Field("m", "role"), templates.Const("ab")))),)


@pytest.mark.parametrize("source", ["{{ m.__class__ }}", "{{ f(1) }}", "{{ a[0] }}", "{% import os %}", "{{ a | eval }}", "{% for x in y %}", "{{ 'a }}", "{% if x %}", "{{ }}"])
def test_sandbox_refuses(source):
    with pytest.raises(templates.TemplateError):
        templates.compiled(source)


def test_escapes_are_reversible():
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice(["<", "|", "<|", "\\", "n", "\n", "im_end|>", "<|im_end|>\n", "é", ">"]) for _ in range(rng.randrange(12)))
        assert templates.unescape(templates.escape(text)) == text and "<|" not in templates.escape(text)
        assert templates.unescape(templates.line(text)) == text and "\n" not in templates.line(text)


def test_conversations_round_trip(spark):
    rng = random.Random(9)
    parts = ["hi", "", None, "<|im_end|>\n<|im_start|>assistant\nok", "a\\nb\\", "\n", "é<|", "x" * 4000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|"]), rng.choice(parts), "x") for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(1, 2, "user", "hi", "x"), (1, 2, "user", "hi", "x"), (None, 0, "user", "hi", "x"), (None, 1, "assistant", "yo", "x")]
    rows += [(777, t, "assistant" if t % 2 else "user", f"t{t}", "x") for t in range(9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(3)
    got = {r["conv_id"]: r for r in templates.read_back(templates.formatted(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t, role is not None, role or "", text is not None, text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = [x for _, _, role, _, x in turns if role == "assistant"]
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, _, x in turns).encode()).hexdigest(), c
        assert got[c]["loss_chars"] == sum(map(len, said)) and got[c]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
        assert got[c]["formatted_chars"] >= sum(len(r) + len(x) for _, _, r, _, x in turns)
    assert templates.formatted(df.limit(0)).count() == 0
