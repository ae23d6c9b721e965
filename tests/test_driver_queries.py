"""Every registered driver query against its DuckDB oracle (sf0.001)."""

import datetime as dt
import decimal
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

# The queries of the optional subpackage have tests of their own.
OWN = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(_norm(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "pass_rate" in df.columns


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    rows_only = OWN - set(entry.oracle_sql())
    assert rows_only == {"landing_manifest"}


@pytest.mark.parametrize("name", sorted(OWN & set(entry.oracle_sql())))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows, scols = df.collect(), df.columns
    rel = duck.execute(entry.oracle_sql()[name])
    drows, dcols = rel.fetchall(), [d[0] for d in rel.description]
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _canon(scols, srows) == _canon(dcols, drows)
