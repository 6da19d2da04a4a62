"""The numbered queries at the smallest size: registration, columns, and SQL where there is some."""

import os

import duckdb
import pytest

import __spark_entry__
from palimpsest.llm import queries as llm

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": "doc_id piece start length ids_crc32 sequence_id offset", "op2_": "doc_id keep_id group_size kept text_sha256", "op3_": "doc_id held_out lang_pred score",
    "op4_": "doc_id n_tokens ids_sha256 decoded_sha256", "op5_": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7_": "doc_id fingerprint component_id",
    "op8_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9_": "doc_id size text_crc32 law shard slot grown_shard", "op10_": "page_id url text n_chars",
    "op11_": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley", "op12_": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op13_": "vec_id component n deviation whitened explained identity_error",
}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(p) for n in names) == 1 for p in (*COLUMNS, "op6_"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("prefix", COLUMNS)
def test_columns_and_sql(spark, tmp_path, prefix):
    name = next(n for n in llm.queries() if n.startswith(prefix))
    out = llm.queries()[name](spark, DATA)
    want = COLUMNS[prefix].split()
    assert out.columns[: len(want)] == want
    if name in llm.oracle_sql():
        out.write.parquet(f"{tmp_path}/out")
        con = duckdb.connect()
        for table in ("documents", "labels", "benchmark"):
            con.sql(f"CREATE VIEW {table} AS FROM '{DATA}/{table}.parquet'")
        a, b = con.sql(llm.oracle_sql()[name]).df(), con.sql(f"FROM '{tmp_path}/out/*.parquet'").df()  # noqa: F841
        columns = ", ".join(out.columns)
        assert con.sql(f"SELECT count(*) FROM (SELECT {columns} FROM a EXCEPT ALL SELECT {columns} FROM b)").fetchall() == [(0,)] and len(a) == len(b)
