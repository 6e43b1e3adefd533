"""Documents to training tokens: toxicity, exact and near duplicates, source mixture, BPE."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgledger.llm import bpe, exact, minhash, mixing, toxicity
from msgledger.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled documents outside the held-out fold.

    Null and empty texts are scored like a text that saves nothing. Null and repeated doc_ids go or stay row by row, as the text says; other
    columns, of whatever names, are kept. With too few labels, or an empty table, the share of label 1 decides, or there are no rows.
    """
    return toxicity.keep_ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays.

    Null and empty texts are one group. A null doc_id counts as larger than all others. Of rows equal in doc_id and text one stays, chosen
    by its other columns, so the same on a rerun. An empty table gives no rows.
    """
    return exact.keep_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays; links are operator 5's, of a similarity of 0.85 or more.

    Null and empty texts have no shingles and all stay. A null doc_id counts as larger than all others. Of rows equal in doc_id and text
    one stays, the same on a rerun. An empty table gives no rows.
    """
    return minhash.keep_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson draw says, in a global order by a hash.

    Texts aren't looked at. A null source is a source like others; rows with one doc_id, null ones too, get one draw. An empty table gives no rows.
    """
    return mixing.mix(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of them and of the text decoded from them.

    A null text counts as empty and has no ids. Null and repeated doc_ids are kept row by row; other columns aren't read. An empty table gives no rows.
    """
    tokenizer = bpe.read_tokenizer(public_tokenizers.path(TOKENIZER))
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    encoded = bpe.encode(docs, tokenizer).select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"))
    return bpe.decode(encoded, tokenizer, keep=True).select("doc_id", F.col("ids").alias("token_ids"), "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
]

#: Trained models are not for SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
