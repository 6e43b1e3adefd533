import random
from collections import defaultdict

import pytest

from msgledger.llm import near, paragraphs
from tests.llm.test_dedup import components, shingle_set, words

SCHEMA = "doc_id bigint, text string, para string, node int"


def brute(rows, min_words):
    paras = []
    for i, t in rows:
        for k, (lo, hi) in enumerate(paragraphs.split(t or "")):
            w = words(t[lo:hi])
            if len(w) >= min_words:
                paras.append((i, k, lo, hi, tuple(w)))
    order = lambda p: (p[0] is None, p[0] or 0, p[1])
    out = []
    for g in components(paras, [shingle_set(" ".join(p[4])) for p in paras], 80, 100):
        if len(g) > 1:
            first = min((paras[i] for i in g), key=order)
            out += [(str(paras[i][0]), paras[i][1], paras[i][2], paras[i][3], str(first[0]), first[1], len(g)) for i in g]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))] for _ in range(25)]
    out = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            p = list(rng.choice(pool)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "changed"
            lines.append(("  " if rng.random() < 0.2 else "") + " ".join(p))
        out.append((i, "\n\n".join(lines)))
    return out


@pytest.mark.parametrize("block", [3, 2048])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = texts(block) + [(100, None), (101, ""), (None, "w " * 40), (102, "w " * 40 + "\n" + "w " * 40), (102, "\u2003é " + "w " * 39 + "\t")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = paragraphs.repeated_passages(docs, min_words=10).collect()
    assert sorted((str(r.doc_id), r.para, r.start, r.end, str(r.first_doc_id), r.first_para, r.copies) for r in got) == brute(rows, 10)
    by = defaultdict(list)
    for r in got:
        by[r.first_doc_id, r.first_para].append(r.removed)
    assert all(x.count(False) == 1 for x in by.values())


def test_empty_and_no_repeats(spark):
    assert paragraphs.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert paragraphs.repeated_passages(spark.createDataFrame([(1, "one two three", "x", 1)], SCHEMA)).count() == 0


def test_hard_wrapped_and_long_lines(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"n{rng.randrange(5000)}" for _ in range(n)]
    wrapped = lambda w, k: "\n".join(" ".join(w[i : i + k]) for i in range(0, len(w), k))
    run = fresh(500)
    near = list(run)
    near[250] = "changed"
    rows = [(1, wrapped(fresh(70) + run + fresh(40), 12)), (2, wrapped(fresh(33) + near, 9)), (3, "\n\n".join([wrapped(run, 7), " ".join(fresh(60))])), (4, " ".join(fresh(800) + run + fresh(700))), (5, " ".join(fresh(800) + near + fresh(900)))]
    text = dict(rows)
    known = {x: i for i, x in enumerate(run)}
    for i, part in ((i, [t[lo:hi].split() for lo, hi in paragraphs.split(t)]) for i, t in rows):
        assert all(len(w) >= paragraphs.MIN_WORDS for w in part)
        if i < 4:
            assert [x for w in part for x in w] == text[i].split()
    got = defaultdict(set)
    for r in paragraphs.repeated_passages(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect():
        got[r.doc_id] |= {known[x] for x in text[r.doc_id][r.start : r.end].split() if x in known}
    assert all(len(got[i]) > 0.6 * len(known) for i in text), {i: len(got[i]) for i in text}


def test_pieces_are_bounded():
    assert max(hi - lo for lo, hi in paragraphs.split("w\n" * 1000)) <= 4 * paragraphs.MAX_PART
    assert sum((hi - lo + 1) // 2 for lo, hi in paragraphs.split("w\n" * 1000)) == 1000
