"""Queries that SQL can express, against DuckDB over the whole tables."""

import os

import duckdb
import pytest

from sluice.llm.oracles import ORACLES
from sluice.llm.queries import QUERIES
from tests.conftest import SF_SMALL

TABLES = "documents embeddings pages benchmark labels conversations".split()


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    df = QUERIES[name](spark, SF_SMALL)
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert _canon(df.columns, df.collect()) == _canon(columns, rel.fetchall())
