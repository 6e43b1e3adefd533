"""The driver's queries over these operators: ``(spark, sf_dir) -> DataFrame``, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgledger.llm import bpe, exact, minhash, mixing, quality, runs, secrets, topk, toxicity, urls
from msgledger.llm.oracles import SQL

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded_and_decoded(docs: DataFrame) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    tokenizer = bpe.read_tokenizer(public_tokenizers.path(TOKENIZER))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    encoded = bpe.encode(docs, tokenizer).select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"))
    return bpe.decode(encoded, tokenizer).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


#: The rules that the URL query applies.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op2_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_decoded(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_rate", "mix_copies", "mix_copy", "mix_order", F.sha2("text", 256).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base, every = secrets.span_text(F.col("base")), secrets.span_text(F.array_sort(F.concat("base", "added")))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.repeated_text(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_bpe_encoding_decoding,
        op3_toxicity,
        op4_exact_dedup,
        op5_minhash_near_dedup,
        op6_mixing_sources,
        op7_quality,
        op8_secret_scans,
        op9_exact_topk,
        op10_substring_dedup,
    )
}

__all__ = ["QUERIES", "SQL"]
