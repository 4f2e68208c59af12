"""Every registered query of the core against its SQL, over whole tables at the smallest scale (QUERY_SF for others)."""

import math
import os

import duckdb
import pytest

from sparsemill.plans.queries import all_queries

DIR = os.environ.get("QUERY_SF", "/root/testdata/sf0.001")
R = all_queries()


def connect(directory=DIR):
    c = duckdb.connect()
    for f in os.listdir(directory):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{directory}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same(df, sql, connection):
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    ref = connection.execute(sql)
    cols = [x[0] for x in ref.description]
    assert sorted(cols) == names
    want = sorted((tuple(norm(dict(zip(cols, r))[c]) for c in names) for r in ref.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query(spark, name):
    df = R.queries[name](spark, DIR)
    if name in R.sql:
        same(df, R.sql[name], connect())
    else:
        assert df.collect() is not None
