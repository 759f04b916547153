"""The pipeline stage by stage, against plain re-computations."""

import hashlib
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from quorumlake.llm import registry
from tests.llm.test_jaccard import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_are_the_four_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near duplicates", "mix sources", "tokenize"] and P.ORACLE_SQL is None


def test_toxic_documents_go(spark, sf):
    """On the next larger table: the smallest has 9 toxic texts to learn from."""
    sf = sf.replace("sf0.001", "sf0.01")
    kept = P.detoxify(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert kept.columns == COLUMNS
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    clean = labels[labels.toxic == 0].doc_id
    assert clean.isin(ids).mean() > 0.98
    assert labels[labels.toxic == 1].doc_id.isin(ids).mean() < 0.3


def test_one_of_each_group_stays(spark, docs, sf):
    some = docs.where("n_chars < 3000")
    kept = P.deduplicate(spark, some, sf)
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    want = {i for i, (_, c) in brute(rows, 5, 80, 100).items() if c == i}
    assert kept.columns == COLUMNS and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_repeated_and_odd_rows(spark, docs, sf):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "null id", "en", "s", 1)]
    df = spark.createDataFrame(rows, docs.schema)
    kept = sorted((r["doc_id"] or 0) for r in P.deduplicate(spark, df, sf).collect())
    assert kept == [0, 1, 3, 4]
    kept = {name: stage(spark, df, sf) for name, stage in P.STAGES}
    assert kept["toxicity"].count() == 6 and kept["tokenize"].count() == 6
    assert {(r["doc_id"], r["text"]) for r in kept["mix sources"].collect()} <= {(r[0], r[1]) for r in rows}
    assert all(stage(spark, df.limit(0), sf).count() == 0 for _, stage in P.STAGES)


def test_columns_of_clashing_names_travel_along(spark, docs, sf):
    """Every stage keeps them as they are, and the rows it keeps without them."""
    names = ["score", "__score", "id", "__id", "r", "t", "copies", "replica", "shuffle_key", "steps", "place", "key", "n_tokens", "ids", "__text", "n_shingles", "component_id", "set_id", "c0", "count"]
    long = [(100, "word " * 30_000, "en", "s", 150_000), (101, None, None, None, None)]
    some = docs.where("doc_id < 60 and n_chars < 3000").unionByName(spark.createDataFrame(long, docs.schema)).withColumn("n_chars", F.lit(1).cast("long"))
    wide = some.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in P.STAGES:
        out, plain = stage(spark, wide, sf), stage(spark, some, sf)
        rows = out.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.collect())
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
        assert out.columns == wide.columns if name != "tokenize" else {"n_tokens_", "ids_", "ids_sha256"} <= set(out.columns)


def test_mixture_and_tokens(spark, docs, sf):
    mixed = P.mix(spark, docs, sf)
    assert mixed.columns == COLUMNS and abs(mixed.count() - docs.count()) < 0.3 * docs.count()
    lib = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path())
    texts = dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
    for r in P.tokenize(spark, mixed, sf).where(F.col("doc_id") % 5 == 0).collect():
        ids = lib.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_whole_run(spark, sf):
    out = P.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0
    assert not re.search("text", " ".join(out.columns))
