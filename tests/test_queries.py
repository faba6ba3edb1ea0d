"""Every registered query against its DuckDB SQL on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from gridloom.plans.oracle import ORACLE
from gridloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def rows(frame, columns):
    shown = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(shown(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, tables, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), tables.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    numbers = [c for c in columns if got[c].dtype.kind in "iuf" or want[c].dtype.kind in "iuf"]
    got, want = (f.astype({c: float for c in numbers}) for f in (got, want))
    assert rows(got, columns) == rows(want, columns)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_registers_the_queries(spark):
    spec = importlib.util.spec_from_file_location("entry_module", Path(__file__).parent.parent / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(QUERIES) <= set(module.queries()) and set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() > 0
