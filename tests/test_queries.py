"""Every query against its SQL in another engine, on whole tables."""

import math
from datetime import date, datetime

import duckdb
import pytest

from parlance.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (datetime, date)):
        return str(value)[:19]
    if hasattr(value, "is_integer"):
        return round(float(value), 6)
    return value


def bag(rows, names):
    return sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, tables, duck, name):
    mine = QUERIES[name](spark, tables)
    theirs = duck.sql(ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert bag([tuple(r) for r in mine.collect()], mine.columns) == bag(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, tables, name):
    rows = QUERIES[name](spark, tables)
    assert len(set(rows.columns)) == len(rows.columns)
    rows.collect()


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
