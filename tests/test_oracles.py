"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as E
from loanlens.sources.tables import TABLES

ORACLES = E.oracle_sql()
SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, srows) == _rows(ocols, cur.fetchall())


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs = E.queries()
    assert set(ORACLES) <= set(qs)
    out = E.entry(spark)
    assert out.count() == 7 and set(out.columns) == {"loan_grade", "n", "default_rate_pct", "mean_loan_to_income"}
