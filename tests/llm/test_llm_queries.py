"""Registered queries: those with SQL against it, all of them for their contract's columns."""

import pytest
from check_oracle import compare, duck

from tarnlake.llm.queries import QUERIES

CONTRACT = {
    "op2": "doc_id size text_crc32 law shard slot grown_shard", "op4": "doc_id n_shingles component_id", "op5": "doc_id held_out score predicted",
    "op6": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "page_id payload_bytes payload_digest record_type refers_to", "op9": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_against_sql(spark, sf_dir, name):
    ok, message, _ = compare(spark, duck(sf_dir), name, QUERIES[name], sf_dir)
    assert ok, message


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in CONTRACT])
def test_contract(spark, sf_dir, name):
    out = QUERIES[name].run(spark, sf_dir)
    assert set(CONTRACT[name.split("_")[0]].split()) <= set(out.columns)
    source = "pages" if name.startswith("op8") else "documents"
    assert out.count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
