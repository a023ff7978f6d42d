"""Every query that has SQL gives the rows that an independent engine gives."""

import decimal
import math
import os

import pytest

from strataline.plans import queries

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return c


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return ("nan" if math.isnan(v) else v + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    got = db.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert ours == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"align_volumes"}))
def test_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
