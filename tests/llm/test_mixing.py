import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from msgledger.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, mix_copies string, k int"


def brute_copies(doc_id, rate):
    parts = max(1, math.ceil(rate / mixing.LARGEST_MEAN))
    total = 0
    for i in range(1, parts + 1):
        u = int(hashlib.sha256(f"{mixing.SEED}|{i}|{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        mean, k = rate / parts, 0
        p = c = math.exp(-mean)
        while c <= u and k < 2000:
            k += 1
            p *= mean / k
            c += p
        total += k
    return total if rate > 0 else 0


def table(spark, n=400):
    rows = [(i, "big" if i % 3 else (None if i % 2 else f"s{i % 10}"), f"text {i}", "c", 1) for i in range(n)]
    rows += [(None, "big", None, "c", 1), (5, "big", "text 5", "c", 1), (5, "big", "text 5", "c", 1)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_against_brute_force(spark):
    rows, docs = table(spark)
    n = Counter(r[1] for r in rows)
    w = {s: k**0.5 for s, k in n.items()}
    rate = {s: w[s] / sum(w.values()) * len(rows) / k for s, k in n.items()}
    mixed = mixing.mix(docs)
    got = Counter((r.doc_id, r.source, r.text, r.mix_copy) for r in mixed.collect())
    want = Counter((i, s, t, k) for i, s, t, _, _ in rows for k in range(brute_copies(i, round(rate[s], 9))))
    assert got == want
    order = [r.mix_order for r in mixed.select("mix_order").collect()]
    assert order == sorted(order)
    assert {"doc_id", "source", "text", "k"} <= set(mixed.columns)


def test_target_weights(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.lit("t").alias("text"))
    weights = spark.createDataFrame([("hot", 1.0), ("s1", 1.0), ("s2", 2.0), ("unknown", 5.0), ("s3", None)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.mix(docs, weights=weights).groupBy("source").count().collect()}
    assert set(got) == {"hot", "s1", "s2"}
    for s, share in (("hot", 0.25), ("s1", 0.25), ("s2", 0.5)):
        assert abs(got[s] - 30_000 * share) < 5 * math.sqrt(30_000 * share) * 3


@pytest.mark.parametrize("rate", [0.0, 0.3, 4.0, 300.0, 1500.0])
def test_poisson_of_large_and_small_means(spark, rate):
    ids = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    got = {r.doc_id: r.mix_copies for r in mixing.copies(ids, size=rate).collect()}
    assert got == {i: brute_copies(i, rate) for i in range(300)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == 0


def test_without_broadcast(spark, monkeypatch):
    rows, docs = table(spark, 60)
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == want
