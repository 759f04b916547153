"""The corpus pipeline: stages over documents, each written and read again.

All stages: a null text counts as an empty one; texts of any length are read whole;
an empty table gives none; columns beside those of documents travel along, whatever
their names (the tokens' own columns take underscores behind clashing names); null
ids, languages and sources are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import jaccard, mixing, piece_bpe, toxicity
from quorumlake.llm.registry import tokenizer_path
from quorumlake.session import scratch


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; it is fitted on the labelled ones
    among ``docs``.  Empty texts are scored like texts without words; equal rows share
    their fate; without labels of both kinds all stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = mixing.free_name("score", docs.columns)
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least id.
    Rows without words are kept, as are null ids; repeated rows (one id and text) become one."""
    found = jaccard.jaccard_components(docs, k=5, num=80, den=100)
    gone = found.where("component_id is not null and doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    kept = rows.join(gone, F.col("r.doc_id") == F.col("id"), "left_anti")
    again = rows.where("r.doc_id is not null").groupBy(F.col("r.doc_id").alias("id")).count().where("count > 1").select("id")
    if not again.isEmpty():
        repeated = kept.join(again, F.col("r.doc_id") == F.col("id"), "left_semi").select("r", F.col("r.doc_id").alias("id"), F.col("r.text").alias("t")).dropDuplicates(["id", "t"]).select("r")
        kept = kept.join(again, F.col("r.doc_id") == F.col("id"), "left_anti").unionByName(repeated)
    return kept.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources move towards their target weights: documents are repeated or go, rows
    of one id alike.  ``docs`` is a plain scan, as stages read it."""
    return mixing.mix_sources(docs, seed=3, stable=True).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with digests of the ids and of the decoded text."""
    added = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    out = piece_bpe.piece_round_trip(docs.toDF(*inner), tokenizer_path(), text=inner[docs.columns.index("text")], keep=[n for n, c in zip(inner, docs.columns) if c != "text"], emit=added)
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, docs.columns) if c != "text"], *[F.col(n).alias(mixing.free_name(n, docs.columns)) for n in added])


STAGES = [
    ("toxicity", detoxify),
    ("near duplicates", deduplicate),
    ("mix sources", mix),
    ("tokenize", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
