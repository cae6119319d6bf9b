"""Every query that has SQL against DuckDB on the same tables."""

import pytest

from graphloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, values):
    def one(v):
        if v is None or v != v:
            return "~"
        return str(v) if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else repr(float(v))

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(one(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry_without_the_training_data_operators(spark, sf_dir):
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "hop"]


def test_imports_without_a_session():
    import subprocess
    import sys

    from conftest import ROOT

    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0 and int(run.stdout.split()[0]) > 200, run.stderr
