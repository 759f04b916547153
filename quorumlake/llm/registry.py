"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorumlake.llm import chats, image_copies, jaccard, licenses, mips, mixing, periodic, piece_bpe, shards, spelling, toxicity, url_filter, warc

# The rules that the url query applies.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_bpe.piece_round_trip(docs, tokenizer_path(), keep=["doc_id"], emit=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, stable=True)


OP4_SQL = """
with parts as (
  select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages),
u as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(rh, rp, rv) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j as (select u.*, rh || rp as rule, rv from u left join rules
      on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)),
best as (select *, row_number() over (partition by page_id order by length(rule) desc nulls last) as k from j)
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from best where k = 1
"""


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_url_filter": op4_url_filter,
        "op5_image_copies": image_copies.op5_image_copies,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_mips": mips.op7_mips,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_shards": shards.op9_shards,
        "op10_licenses": licenses.op10_licenses,
        "op11_chats": chats.op11_chats,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict:
    return {"op1_warc": warc.SQL, "op3_mix_sources": mixing.SQL, "op4_url_filter": OP4_SQL, "op10_licenses": licenses.SQL, "op11_chats": chats.SQL}
