from collections import Counter

import corpus_pipeline
from msgledger.llm import exact, minhash, mixing, toxicity
from tests.llm.test_bpe import library
from tests.llm.test_mixing import brute_copies


def test_stages_one_by_one(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    left = [r for i, r in rows.items() if i not in toxic]
    frame = spark.createDataFrame(left, docs.schema)
    dropped = {r.doc_id for r in exact.exact_duplicates(frame).where("NOT kept").collect()}
    left = [r for r in left if r.doc_id not in dropped]
    frame = spark.createDataFrame(left, docs.schema)
    dropped = {r.doc_id for r in minhash.near_duplicates(frame).where("NOT kept").collect()}
    left = [r for r in left if r.doc_id not in dropped]
    n = Counter(r.source for r in left)
    w = {s: k**mixing.ALPHA for s, k in n.items()}
    rate = {s: round(w[s] / sum(w.values()) * len(left) / k, 9) for s, k in n.items()}
    want = Counter()
    for r in left:
        ids, _ = library(r.text)
        if k := brute_copies(r.doc_id, rate[r.source]):
            want[r.doc_id, ids] += k
    got = Counter((r.doc_id, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want
    assert 0 < len(want) < len(rows)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
