"""Every query with a SQL text: Spark result == DuckDB result (sf0.001)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from oracle_check import digest, duck
from conftest import SMOKE

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    df = E.queries()[key](spark, SMOKE)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[key])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


def test_every_key_has_a_query_and_entry_runs(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert len(qs) >= 80
    out = E.entry(spark)
    assert out.count() >= 0 and "revenue_delta" in out.columns
