import math

import pytest

import __spark_entry__ as entry
from earshot.queries.core import QUERIES
from earshot.queries.sql import SQL


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(float(x), 9) if isinstance(x, int | float) and not isinstance(x, bool) else x


def _table(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_cell, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        assert _table(got) == _table(duck.sql(SQL[name]).df())
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
