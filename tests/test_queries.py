"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from pulsegrid.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(frame: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, float, np.integer, np.floating)):
            return float(f"{float(x):.7g}")
        return str(x) if isinstance(x, pd.Timestamp) else x

    return sorted((tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, database, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), database.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["charger_id", "type", "timestamp", "value", "seq"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
