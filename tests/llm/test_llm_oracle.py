"""The subpackage's queries against their DuckDB twins on the smallest tables, and their result columns."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, TYPES, digest

SF = "/root/testdata/sf0.001"
# the columns that the contracts fix
COLUMNS = {
    "op1_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2_ngram_join": "doc_id n_shingles component_id",
    "op3_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_token_count": "doc_id n_bytes n_tokens over_limit",
    "op8_html_extract": "page_id url text n_chars",
    "op9_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op12_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", sorted(E.LLM_ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    cols, want = [d[0] for d in res.description], res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields} \
        == {d[0]: str(d[1]) for d in res.description}
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, want)[0]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_result_columns(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.columns[:len(COLUMNS[name].split())] == COLUMNS[name].split()
