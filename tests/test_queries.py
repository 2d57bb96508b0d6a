"""Each registered query of the library gives the rows of its SQL on the test tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from laminar.plans import registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(names, found):
    return sorted(repr([plain(dict(zip(names, r, strict=True))[n]) for n in sorted(names)]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql()[name]
    rel = duck.sql(sql)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, duck.sql(sql).fetchall())
