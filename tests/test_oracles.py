"""Every query of the trip engine against its DuckDB SQL at the smallest size."""

import datetime
import decimal
import os

import duckdb
import pytest

from wayline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    at = [want.columns.index(c) for c in cols]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == expected


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ride_id", "n_fixes", "distance_m", "moving_ms", "max_speed", "avg_speed"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
