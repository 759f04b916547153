"""Queries that compare balances, on balances of -0.0: as in SQL, it is equal to 0.0."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quorumlake.operators import link
from quorumlake.operators import manifest as M
from quorumlake.plans import catalog


@pytest.fixture(scope="module")
def balances(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zero"))
    duckdb.sql(f"""copy (select i as c_custkey, 'Customer#' || i as c_name, (i % 25)::int as c_nationkey, case when i % 3 = 0 then '-0.0'::double when i % 3 = 1 then 0.0::double else i::double end as c_acctbal, 'BUILDING' as c_mktsegment
                   from range(400) r(i)) to '{path}/customer.parquet'""")
    return path


@pytest.mark.parametrize("name", ["j30_snapshot_diff", "job_data_manifest"])
def test_minus_zero_is_zero(spark, balances, name):
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{balances}/customer.parquet'")
    rel = db.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, balances).select(*rel.columns).collect()
    assert Counter(map(tuple, got)) == Counter(rel.fetchall())


def test_minus_zero_inside(spark):
    one = "struct<x:double,y:array<float>,z:map<string,double>>"
    rows = lambda zero: spark.createDataFrame([(1, (zero, [zero, None, 2.0], {"k": zero}), zero), (2, None, None)], f"id int, v {one}, w double")
    a, b, c = rows(0.0), rows(-0.0), rows(1.0)
    assert link.snapshot_diff(a, b, "id", ["v", "w"]).isEmpty() and link.snapshot_diff(a, c, "id", ["v"]).count() == 1
    digest = lambda t: M.shard_digests(t, F.lit(0), ["id", "v", "w"]).first()["digest"]
    assert digest(a) == digest(b) != digest(c)
