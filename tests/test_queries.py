"""Every query with SQL gives DuckDB's rows at the smallest size."""

import os

import duckdb
import pytest

from palimpsest.plans import imports, navigation, queries  # noqa: F401
from palimpsest.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    if name in ORACLE_SQL:
        want, got = oracle.sql(ORACLE_SQL[name]).df(), oracle.sql(f"FROM '{tmp_path}/out/*.parquet'").df()
        assert sorted(want.columns) == sorted(got.columns)
        columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
        for a, b in (("want", "got"), ("got", "want")):
            assert oracle.sql(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchall() == [(0,)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
