"""Every registered query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from larkspur.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    return c


def rows(frame, columns):
    frame = frame[columns].copy()
    for c in columns:
        if frame[c].map(lambda x: isinstance(x, float)).any():
            frame[c] = frame[c].astype(float).round(8)
        frame[c] = frame[c].astype(str).replace({"None": "NULL", "nan": "NULL", "<NA>": "NULL", "NaT": "NULL"})
    return sorted(map(tuple, frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf, duck):
    want = duck.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
