"""Every registered query against its DuckDB oracle on sf0.001
(row count, column names, order-insensitive values)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from quadrangle import registry
from tools.oracle_check import BASE, digest

from .conftest import SF_SMALL

NAMES = sorted(registry.queries())  # the corpus queries have tests of their own
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_a_name_and_most_have_oracles():
    assert len(NAMES) >= 80
    no_oracle = [n for n in registry.queries() if n not in SQL]
    assert no_oracle == []


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    assert len(rows) == len(o_rows)
    assert digest(df.columns, rows)[0] == digest(o_cols, o_rows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["etudiant_id", "moyenneGenerale", "totalCredits"]
    assert df.count() > 0
