"""Every registered fact query against its SQL on DuckDB."""

import duckdb
import pytest

from loomfact.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, tmp_path, name):
    out = str(tmp_path / name)
    QUERIES[name](spark, sf_dir).write.parquet(out)
    con.sql(f"CREATE OR REPLACE VIEW got AS SELECT * FROM read_parquet('{out}/*.parquet')")
    if name not in ORACLE:
        assert con.sql("SELECT count(*) FROM got").fetchall()[0][0]
        return
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == sorted(con.sql("FROM got").columns)
    cols = ", ".join(f'"{c}"' for c in want.columns)
    con.sql(f"CREATE OR REPLACE TABLE expected AS SELECT {cols} FROM ({ORACLE[name]})")
    for a, b in (("expected", "got"), ("got", "expected")):
        assert con.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
