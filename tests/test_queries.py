"""Each registered query of the library against DuckDB on the smallest data."""

import duckdb
import pytest

from marlstone.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value.asDict() if hasattr(value, "asDict") else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted(str([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    at = [columns.index(c) for c in sorted(columns)]
    assert mine == sorted(str([plain(r[k]) for k in at]) for r in cursor.fetchall())
