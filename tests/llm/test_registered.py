"""The registered queries: contract columns, and SQL where there is some."""

import duckdb
import pytest

from spanweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_token_files": "doc_id start n_tokens ids_crc32",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_language": "doc_id held_out lang_pred score",
    "op6_html": "page_id url text n_chars",
    "op8_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_near_copies": "doc_id n_shingles component_id",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    table = "pages" if name == "op6_html" else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
