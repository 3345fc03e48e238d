"""Every registered corpus query on the smallest tables: its contract's columns, one row per document, and its SQL where there is any."""

from __future__ import annotations

import zlib
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_neardup": "doc_id n_shingles component_id kept",
    "op5_substrings": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_sharding": "doc_id",
    "op9_language": "doc_id",
    "op10_templates": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op11_crosspolytope": "query_id rank vec_id score",
    "op12_hybridrank": "item_id rank doc_id score",
    "op13_prefixtrie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ids = [r[0] for r in con.sql("SELECT doc_id FROM documents").fetchall()]
    if name == "op10_templates":
        assert [r["n_turns"] for r in rows if r["conv_id"] == -1] == [2]
    elif name == "op3_packing":
        assert {r["doc_id"] for r in rows} == set(ids)
        ends: dict = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(ends.values()) <= 1024
    elif name not in ("op11_crosspolytope", "op12_hybridrank", "op13_prefixtrie"):
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    if name == "op1_toxicity":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    if sql:
        want = con.sql(sql)
        names = sorted(want.columns)
        at = [want.columns.index(c) for c in names]
        assert sorted(tuple(str(r[c]) for c in names) for r in rows) == sorted(tuple(str(r[k]) for k in at) for r in want.fetchall())
