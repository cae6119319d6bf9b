"""The opN_ queries that SQL can express, against DuckDB on the same tables."""

import pytest

from graphloom.llm import op_queries
from graphloom.llm.registry import queries
from test_catalogue import rows


@pytest.mark.parametrize("name", sorted(op_queries.ORACLE_SQL))
def test_equals_duckdb(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries()[name](spark, sf_dir)
    want = con.execute(op_queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
