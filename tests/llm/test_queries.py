"""The registered corpus queries against their SQL, and the contract's columns."""

import duckdb
import pytest

import __spark_entry__ as E
from shopweave.llm import queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_mixing_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6_licenses": {"doc_id": "bigint", "license": "string", "coverage": "double"},
    "op7_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op8_mixing": {"doc_id": "bigint", "epoch": "int"},
    "op9_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_repeats": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op11_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op13_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
}


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS) and set(COLUMNS) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    rows = df.collect()
    if name not in ("op6_licenses", "op8_mixing", "op11_search", "op13_prefix_trie"):
        assert sorted(r.doc_id for r in rows) == list(range(200))
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for table in ("documents", "benchmark", "conversations"):
            con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
        rel = con.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        order = [rel.columns.index(c) for c in df.columns]
        assert sorted((tuple(r) for r in rows), key=repr) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
