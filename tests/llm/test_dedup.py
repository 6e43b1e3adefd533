import hashlib
import random
import re
from collections import defaultdict

import pytest

from msgledger.llm import exact, minhash, near, shingles

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, digest string, rid int, _h int, kept string"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "d", 1, 2, "k") for i, t in pairs], SCHEMA)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if w]


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(ids, sets, num, den):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = defaultdict(list)
    for i in range(len(ids)):
        out[find(i)].append(i)
    return out.values()


def near_copies(seed, n=60, size=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(6, size))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in own))
    return texts


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a  b\tc"), (5, "a b c"), (5, "a b c"), (6, " a b c"), (None, "a b c"), (None, "only null"), (None, "only null"), (7, "é" * 3), (8, "A B\u00a0C"), (9, "x " * 4000), (10, "x  " * 4000)]


def test_exact_against_brute_force(spark):
    got = exact.exact_duplicates(rows_of(spark, EDGES).repartition(5))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in EDGES:
        groups[norm(t)].append(i)
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    rows = got.collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    kept = exact.keep_exact(rows_of(spark, EDGES))
    assert kept.columns == rows_of(spark, []).columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)


@pytest.mark.parametrize("fan_in", [2, 4])
def test_exact_with_one_large_group(spark, fan_in):
    docs = rows_of(spark, [(i, "same text" if i % 3 == 0 else f"text {i % 100}") for i in range(3000)]).repartition(7)
    got = exact.exact_duplicates(docs, fan_in).where("kept").collect()
    assert {(r.doc_id, r.group_size) for r in got} >= {(0, 1000)}
    assert sum(r.group_size for r in got) == 3000


def test_near_edges(spark):
    got = minhash.near_duplicates(rows_of(spark, EDGES)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(
        [
            ("1", 0, "1", True),
            ("2", 0, "2", True),
            ("3", 0, "3", True),
            ("4", 1, "4", True),
            ("5", 1, "4", False),
            ("5", 1, "4", False),
            ("6", 1, "4", False),
            ("None", 1, "4", False),
            ("None", 1, "None", True),
            ("None", 1, "None", True),
            ("7", 1, "7", True),
            ("8", 1, "8", True),
            ("9", 1, "9", True),
            ("10", 1, "9", False),
        ]
    )
    chosen = [r for r in got if r.chosen]
    assert sorted(str(r.doc_id) for r in chosen) == sorted(["1", "2", "3", "4", "None", "7", "8", "9"])
    kept = minhash.keep_near(rows_of(spark, EDGES))
    assert kept.columns == rows_of(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "7", "8", "9"])


@pytest.mark.parametrize("block", [4, 2048])
def test_near_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    texts = near_copies(block)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(rows_of(spark, list(enumerate(texts)))).collect()}
    sets = [shingle_set(t) for t in texts]
    want = {i: (min(g), len(sets[i])) for g in components(range(len(texts)), sets, 85, 100) for i in g}
    assert got == want
    assert len({c for c, _ in want.values()}) < len(texts)


def test_empty_tables(spark):
    none = rows_of(spark, [])
    assert exact.exact_duplicates(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert exact.keep_exact(none).count() == minhash.keep_near(none).count() == 0


def test_odd_sketches_allow_similar_sets():
    rng = random.Random(1)
    sk = shingles.Sketcher(28, 6)
    most = sk.differing_bits(85, 100)
    import numpy as np

    for _ in range(100):
        n = rng.randrange(40, 400)
        base = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        other = base.copy()
        other[: max(1, int(0.07 * n))] = [rng.getrandbits(64) for _ in range(max(1, int(0.07 * n)))]
        other = np.unique(other)
        a, b = (np.frombuffer(sk.odd_sketch(sk.samples(x)), np.uint8) for x in (base, other))
        if 100 * shingles.common(base, other) >= 85 * (len(base) + len(other) - shingles.common(base, other)):
            assert np.bitwise_count(a ^ b).sum() <= most
        c = np.frombuffer(sk.odd_sketch(sk.samples(np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)))), np.uint8)
        assert np.bitwise_count(a ^ c).sum() > most
