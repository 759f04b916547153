"""Every registered query against its SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from quorumlake.plans import catalog

QUERIES, SQLS = catalog.queries(), catalog.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if type(x).__name__ == "Decimal":
        return int(x) if x == int(x) else plain(float(x))
    return x


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name not in SQLS:
        assert got
        return
    rel = db.sql(SQLS[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    assert Counter(got) == Counter(want)
