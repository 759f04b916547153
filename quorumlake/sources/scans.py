"""Sources: marker-filtered JSON lines, gates, delimited tables and versioned caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.session import scratch


def marker_scan(lines: DataFrame, column: str, marker: str, schema: str, recheck: Column) -> DataFrame:
    """Lines with a marker, parsed as ``page`` by a pruned schema; bad JSON goes,
    and the parsed field is tested again.  The outer explode of one page is for speed:
    the optimizer puts plain columns into the tests, which then parse a line again each."""
    page = F.explode_outer(F.array(F.from_json(column, schema))).alias("page")
    return lines.where(F.contains(column, F.lit(marker))).select("*", page).where(F.col("page").isNotNull() & recheck)


def json_lines(spark: SparkSession, path: str, marker: str, schema: str, recheck: Column) -> DataFrame:
    return marker_scan(spark.read.text(path), "value", marker, schema, recheck)


def gated(df: DataFrame, tests: list[tuple[Column, str]], otherwise: str, out: str = "gate") -> DataFrame:
    """The label of the first test that holds."""
    label = F.when(tests[0][0], tests[0][1])
    for test, name in tests[1:]:
        label = label.when(test, name)
    return df.withColumn(out, label.otherwise(otherwise))


def official_table(spark: SparkSession, path: str, schema: T.StructType, tab: bool | None = None) -> DataFrame:
    """A delimited table with quoted multi-line cells; tab: whether tabs separate
    (by default as the first line shows).  Rows without any value go."""
    if tab is None:
        first = spark.read.text(path).limit(1).collect()
        tab = bool(first) and first[0][0].count("\t") > first[0][0].count(",")
    df = spark.read.schema(schema).csv(path, sep="\t" if tab else ",", header=True, multiLine=True, quote='"', escape='"')
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in df.columns]).isNotNull())


def delimited_round_trip(df: DataFrame, keys: list[str]) -> DataFrame:
    spark, path = df.sparkSession, scratch(df.sparkSession, "delimited")
    df.write.csv(path, header=True, quote='"', escape='"')
    return official_table(spark, path, df.schema, tab=False).where(F.col(keys[0]).isNotNull())


def write_versioned(df: DataFrame, name: str, version: int) -> str:
    """A table with its stamp (dataset, schema version, row count) beside it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(f"{path}/data")
    n = spark.read.parquet(f"{path}/data").count()
    spark.createDataFrame([(name, version, n)], "dataset string, schema_version int, row_count long").coalesce(1).write.json(f"{path}/stamp")
    return path


def read_versioned(spark: SparkSession, path: str, name: str, version: int) -> DataFrame:
    """Read a stamped table; a stale stamp or another row count raises."""
    stamp = spark.read.schema("dataset string, schema_version int, row_count long").json(f"{path}/stamp").first()
    if (stamp["dataset"], stamp["schema_version"]) != (name, version):
        raise ValueError(f"{path} holds {stamp['dataset']} of schema {stamp['schema_version']}, not {name} of schema {version}; write it again")
    df = spark.read.parquet(f"{path}/data")
    if df.count() != stamp["row_count"]:
        raise ValueError(f"{path} should hold {stamp['row_count']} rows")
    return df
