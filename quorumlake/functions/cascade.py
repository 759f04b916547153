"""Ordered rewrite cascades with a trace, and per-language transliteration.

Rules are data: id, pattern, replacement, stage, a guard that the value must match
and a rule that blocks this one if it fired.  Stages follow each other, rules of one
stage in their order; the cascade is unrolled into one expression a step, so a
pack of rules is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    put: str
    guard: str | None = None  # a regular expression that the value must match
    stage: int = 0
    unless: str | None = None  # a rule before this one that must not have changed the value


def apply_cascade(df: DataFrame, column: str, rules: list[Rule], out: str = "rewritten", trace: str = "trace") -> DataFrame:
    """Columns ``out`` and ``trace`` (array<struct<id, before, after>> of the
    steps that changed the value).  Each step is a column of its own, so that
    later steps do not repeat earlier ones."""
    rules = sorted(rules, key=lambda r: r.stage)
    place = {r.id: i for i, r in enumerate(rules)}
    if any(r.unless is not None and place.get(r.unless, len(rules)) >= i for i, r in enumerate(rules)):
        raise ValueError("a rule is blocked by one that does not come before it")
    steps = [f"__s{i}" for i in range(len(rules) + 1)]
    df = df.withColumn(steps[0], F.col(column))
    for i, r in enumerate(rules):
        value = F.regexp_replace(F.col(steps[i]), r.pattern, r.put)
        runs = F.col(steps[i]).rlike(r.guard) if r.guard else F.lit(True)
        if r.unless is not None:
            k = place[r.unless]
            runs = runs & (F.col(steps[k]) == F.col(steps[k + 1]))
        df = df.withColumn(steps[i + 1], F.when(runs, value).otherwise(F.col(steps[i])))
    log = F.array(*[F.struct(F.lit(r.id).alias("id"), F.col(steps[i]).alias("before"), F.col(steps[i + 1]).alias("after")) for i, r in enumerate(rules)])
    return df.withColumn(trace, F.filter(log, lambda s: s["before"] != s["after"])).withColumn(out, F.col(steps[-1])).drop(*steps)


def transliterate(word: Column, lang: Column, tables: dict[str, list[tuple[str, str]]]) -> Column:
    """Per-language replacements in order; words of other languages stay."""
    out = F.when(F.lit(False), word)
    for code, pairs in tables.items():
        w = word
        for found, put in pairs:
            w = F.replace(w, F.lit(found), F.lit(put))
        out = out.when(lang == code, w)
    return out.otherwise(word)
