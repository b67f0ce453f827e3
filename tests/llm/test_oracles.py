"""Every contract query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from lectern.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(cols) == sorted(got.columns)
    rounded = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    assert sorted(map(rounded, got.select(*cols).collect()), key=repr) == sorted(map(rounded, cur.fetchall()), key=repr)
