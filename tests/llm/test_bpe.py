from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from msgledger.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string, decoded int"


def library(text):
    t = Tokenizer.from_file(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return tuple(ids), t.decode(ids, skip_special_tokens=False)


def round_trip(docs):
    js = bpe.read_tokenizer(PATH)
    enc = bpe.encode(docs, js)
    dec = bpe.decode(enc.selectExpr("doc_id", "ids", "ids AS own"), js)
    return Counter((r.doc_id, tuple(r.own), r.decoded) for r in dec.collect())


TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c",
    "It's WE'LL don't 123 4é e\u0301 ﬁ İ ΑΣ Σ ß",
    "a<|endoftext|>b <|startoftext|><|EndOfText|>",
    "x\x1cy\x85z\u00a0q\u2003w\x00",
    "日本語 한국어 🙂🙂 ...!?## foo_bar-baz",
    "the " * 3000 + "rare" + "z" * 5000,
    "antidisestablishmentarianism " * 3,
]


@pytest.mark.parametrize("head", [0, 3, 400_000])
def test_as_the_library(spark, monkeypatch, head):
    monkeypatch.setattr(bpe, "HEAD_WORDS", head)
    monkeypatch.setattr(bpe, "CHUNK", 4)
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (3, TEXTS[3], "x", 1), (3, TEXTS[3], "x", 1), (3, "other", "x", 1)]
    got = round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id"))
    assert got == Counter((r[0], *library(r[1])) for r in rows)


def test_generated_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    assert round_trip(docs) == Counter((r.doc_id, *library(r.text)) for r in docs.collect())


def test_empty_table(spark):
    assert not round_trip(spark.createDataFrame([], SCHEMA))
