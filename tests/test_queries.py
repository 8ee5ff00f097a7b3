"""Every registered query of the engine against its SQL, or for rows and a stable schema."""

import glob
import math
import os

import duckdb
import pytest

from breakline.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    cell = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in registry.SQL:
        other = duck.sql(registry.SQL[name])
        assert sorted(other.columns) == columns
        assert plain(rows) == plain(other.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
