import math
import random

import numpy as np
import pytest

from msgledger.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int"


def brute(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    ints = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for qi, q in queries:
        if qi is None or not ok(q):
            continue
        scores = sorted((-sum(a * b for a, b in zip(ints(q), ints(v), strict=False)), i) for i, v in rows if i is not None and i != qi and ok(v))
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "open_"), [(8192, 64), (100, 12)])
def test_against_brute_force(spark, monkeypatch, block, open_):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "OPEN", open_)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(900)]
    rows += [(i, [0.5] * 8) for i in range(900, 930)]  # ties
    rows += [(1000, None), (1001, [0.1, None] * 4), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8), (1100, []), (1200, [0.3, -0.2]), (1300, [0.0] * 8)]
    queries = [(i, v) for i, v in rows if i is None or i % 100 == 0 or i == 905]
    frame = lambda x: spark.createDataFrame([(i, v, "s", 1) for i, v in x], SCHEMA)
    got = topk.top_k(frame(rows).repartition(5), frame(queries), k=7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 7)


def test_fewer_candidates_and_empty(spark):
    frame = lambda x: spark.createDataFrame([(i, v, "s", 1) for i, v in x], SCHEMA)
    few = [(0, [1.0]), (1, [2.0]), (2, [-1.0])]
    assert [tuple(r) for r in topk.top_k(frame(few), frame(few[:1])).orderBy("rank").collect()] == [(0, 1, 1, 2097152), (0, 2, 2, -1048576)]
    assert topk.top_k(frame([]), frame([])).count() == 0
    assert topk.top_k(frame(few), frame([])).count() == 0
    assert topk.top_k(frame([]), frame(few)).count() == 0


def test_repeated_ids(spark):
    frame = lambda x: spark.createDataFrame([(i, v, "s", 1) for i, v in x], SCHEMA)
    rows = [(0, [1.0]), (7, [1.0]), (7, [1.0]), (7, [2.0])]
    got = sorted(map(tuple, topk.top_k(frame(rows), frame([(0, [1.0])])).collect()))
    assert got == [(0, 1, 7, 2 << 20), (0, 2, 7, 1 << 20), (0, 3, 7, 1 << 20)]


def test_reading_ends_before_the_lists_do():
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((4000, 6)) * 200)
    ids = np.arange(4000)
    lists = topk.Lists(x, ids)
    q = x[:20]
    for i, (best, score) in enumerate(lists.top(q, 10, ids[:20])):
        s = (x @ x[i]).astype(int)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        assert best.tolist() == order and score.tolist() == s[order].tolist()
