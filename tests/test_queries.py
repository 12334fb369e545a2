"""Every query of the engine against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from scourline.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def compared(oracle, sql, df, path):
    df.write.parquet(path)
    a, b = oracle.sql(sql), oracle.sql(f"SELECT * FROM '{path}/*.parquet'")
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda x: sorted(map(repr, x.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert rows(b) == rows(a)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, oracle, tmp_path, name):
    compared(oracle, catalog.ORACLE_SQL[name], catalog.QUERIES[name](spark, SF), str(tmp_path / "out"))


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
