"""Repair of pairs: a hand-made pair for each rule, and the guards."""

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import repair as R

SCHEMA = "first string, second string, first_score double, second_score double"
#: (first, second, scores) and what production, and the ladder's last step, make of it.
CASES = [
    ("pisati", "zapisati", 0.8, 0.2, ("pisati", "zapisati", "independent-roots-agree"), None),  # ends with the other root
    ("idti", "hoditi", 0.5, 0.5, ("idti", "pojdti", "closed-suppletive-pair"), None),
    ("hoditi", "VZĘTI", 0.5, 0.5, ("jęti", "vzęti", "closed-suppletive-pair"), None),
    ("bolěti", "dobaviti", 0.2, 0.8, ("dobavjati", "dobaviti", "pf-iti-to-ipf-jati"), None),
    ("motati", "drgnųti", 0.2, 0.8, ("drgati", "drgnųti", "pf-nuti-to-ipf-ati"), None),
    ("dobavjati", "motiti", 0.8, 0.2, ("dobavjati", "dobaviti", "ipf-jati-to-pf-iti"), None),
    ("drgati", "molnųti", 0.8, 0.2, ("drgati", "drgnųti", "ipf-ati-to-pf-nuti"), None),
    ("pokazyvati", "motnųti", 0.8, 0.2, ("pokazyvati", "motnųti", "unrepaired"), ("pokazyvati", "pokazati", "secondary-ipf-yvati-reverse")),
    ("sprašivati", "motnųti", 0.8, 0.2, ("sprašivati", "motnųti", "unrepaired"), ("sprašivati", "sprašati", "secondary-ipf-ivati-reverse")),
    ("prědavati", "motnųti", 0.8, 0.2, ("prědavati", "motnųti", "unrepaired"), ("prědavati", "prědati", "secondary-ipf-avati-reverse")),
    ("organizovyvati", "motnųti", 0.8, 0.2, ("organizovyvati", "motnųti", "unrepaired"), ("organizovyvati", "organizovati", "secondary-ovyvati-to-ovati")),
    ("motyti", "organizovati", 0.2, 0.8, ("motyti", "organizovati", "unrepaired"), ("organizovyvati", "organizovati", "ovati-to-secondary-ovyvati")),
    ("motyti", "kazati", 0.2, 0.8, ("motyti", "kazati", "unrepaired"), ("kazyvati", "kazati", "secondary-ipf-yvati")),
    ("mivati", "kazati", 0.2, 0.8, ("mivati", "kazati", "unrepaired"), ("kazivati", "kazati", "secondary-ipf-ivati")),
    ("mavati", "kazati", 0.2, 0.8, ("mavati", "kazati", "unrepaired"), ("kazavati", "kazati", "secondary-ipf-avati")),
    ("kazyvytj", "kazati", 0.2, 0.8, ("kazyvytj", "kazati", "independent-roots-agree"), None),
    ("dělyvyt", "zadělypap", 0.8, 0.2, ("dělyvyt", "zadělyvyt", "prefix-perfectivization"), None),
    ("kalkulavac", "viličic", 0.8, 0.2, ("kalkulavac", "viličic", "unrepaired"), None),  # what is left of the prefix is too far
    (None, "pisati", None, 0.2, (None, "pisati", "unrepaired"), ("pisavati", "pisati", "secondary-ipf-avati")),
    ("", "", 0.0, 0.0, ("", "", "independent-roots-agree"), None),
]


def made(spark, use):
    df = spark.createDataFrame([(*c[:4], i) for i, c in enumerate(CASES)], SCHEMA + ", n int")
    return {r["n"]: (r["fixed_first"], r["fixed_second"], r["rule"]) for r in R.repair(df, R.VERBS, use).collect()}


def test_each_rule(spark):
    production, last, none = made(spark, R.LADDER["prefixes"]), made(spark, R.LADDER["secondary"]), made(spark, ())
    for i, (a, b, _, _, want, more) in enumerate(CASES):
        assert none[i] == (a, b, "independent-baseline")
        assert production[i] == want, i
        assert last[i] == (more or want), i


def test_an_inventory_that_drifts_is_refused():
    assert R.VERBS.guarded(R.VERBS.digest()) is R.VERBS
    changed = R.Inventory(R.VERBS.rules[:-1], R.VERBS.prefixes, R.VERBS.exceptions)
    with pytest.raises(ValueError):
        changed.guarded(R.VERBS.digest())


def test_the_manifest_does_not_depend_on_order(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("g"), F.col("id").alias("l"), (F.col("id") * 3).alias("r"))
    a, b = R.manifest_digest(rows, "g", "l", "r").first(), R.manifest_digest(rows.orderBy(F.desc("id")).repartition(5), "g", "l", "r").first()
    assert a == b and a["pairs"] == 500 and a != R.manifest_digest(rows.where("id <> 3"), "g", "l", "r").first()


def test_the_ladder_reads_its_pairs_once(spark):
    """options are made once for all configurations, and give what each gives alone."""
    df = spark.createDataFrame([(*c[:4], i) for i, c in enumerate(CASES)], SCHEMA + ", n int").withColumns({"gold_first": F.col("first"), "gold_second": F.col("second")})
    scored = R.score_ladder(df, R.VERBS, F.col("n").cast("string"), "gold_first", "gold_second")
    assert scored._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    got = {(r["config"], r["n"]): (r["fixed_first"], r["fixed_second"], r["rule"]) for r in scored.collect()}
    assert got == {(name, n): row for name, use in R.LADDER.items() for n, row in made(spark, use).items()}
