"""Queries whose work outgrew their input: same rows as the SQL, on tables with repeated ids, and no step that carries pairs."""

import re
from collections import Counter

import duckdb
import pytest

from quorumlake.operators import lexical, walks
from quorumlake.plans import catalog
from tests.test_walks import matched, walk_pairs


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Few kinds of parts, many of each, some ids of several rows."""
    path = str(tmp_path_factory.mktemp("growth"))
    duckdb.sql(f"""copy (select case when i % 40 = 7 then i - 1 else i end as p_partkey, ['large', 'hot', 'red'][(i % 3 + 1)::int] || ' ' || ['ring', 'bolt', 'nut'][(i % 7 % 3 + 1)::int] as p_name, 'Brand#' || (i % 4 * 5) as p_brand,
                   ['SMALL', 'LARGE'][(i % 2 + 1)::int] as p_type, (i % 50)::int as p_size, case when i % 11 = 0 then null else 900 + (i % 5) * 0.5::double end as p_retailprice from range(1200) r(i)) to '{path}/part.parquet'""")
    return path


def same(spark, name, path, table):
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from '{path}/{table}.parquet'")
    rel = db.sql(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, path).select(*rel.columns)
    assert Counter(map(tuple, df.collect())) == Counter(rel.fetchall())


def final_plan(df):
    q = df._jdf.queryExecution()
    q.toRdd().count()
    return q.executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("chunk", [3, 1000])
def test_synonyms_of_repeated_ids(spark, parts, monkeypatch, chunk):
    monkeypatch.setattr(lexical, "CHUNK", chunk, raising=False)
    same(spark, "j14_synonyms", parts, "part")


def test_pairs_of_synonyms_are_not_shuffled(spark):
    rows = spark.range(500).selectExpr("id", "'en' as lang", "'word' as tr", "'n' as pos", "array(cast(id % 5 as string)) as toks", "cast(id % 5 as string) as form")
    plan = final_plan(lexical.synonym_edges(rows, "id", "lang", "tr", "pos", "toks", "form"))
    assert not re.search("(?<!Object)HashAggregate", plan)


def test_best_alternative_of_repeated_ids(spark, parts):
    same(spark, "j18_best_alternative", parts, "part")


def test_rows_of_a_kind_meet_once(spark, parts):
    plan = final_plan(catalog.queries()["j18_best_alternative"](spark, parts))
    assert [line for line in plan.splitlines() if "max_by" in line and "oform" in line]


@pytest.mark.parametrize("walked", [0, 1_000_000])
def test_walks_and_rounds_agree(spark, monkeypatch, walked):
    """Ids that no float holds."""
    monkeypatch.setattr(walks, "WALKED", walked, raising=False)
    monkeypatch.setattr(walks, "ROUNDS", 0)
    key = lambda i: ["br", "brt", "", None, "rt", "tb"][i * 7 % 6]
    left, right = [(f"g{i % 2}", key(i), 2**60 + i) for i in range(40)], [(f"g{i % 2}", key(i + 1), 2**61 + i) for i in range(36)]
    assert {tuple(x) for x in matched(spark, left, right).collect()} == walk_pairs(left, right)


def test_rewriting_stays_above_the_counts(spark, sf):
    plan = catalog.queries()["a22_rule_fired_index"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]
