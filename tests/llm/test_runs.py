import random
from collections import defaultdict

import pytest

from msgledger.llm import runs
from tests.llm.test_dedup import words

SCHEMA = "doc_id bigint, text string, para string, node int"
L = 50


def brute(rows):
    """Indexes of the words, for each row, that lie in 50 words which stand at two places that don't overlap."""
    places = defaultdict(list)
    split = [words(t or "") for _, t in rows]
    for i, w in enumerate(split):
        for k in range(len(w) - L + 1):
            places[tuple(w[k : k + L])].append((i, k))
    out = defaultdict(set)
    for at in places.values():
        if len({i for i, _ in at}) > 1 or at[-1][1] - at[0][1] >= L:
            for i, k in at:
                out[i] |= set(range(k, k + L))
    return out


def covered(text, start, end):
    """Indexes of the words between two code points."""
    before = len(words(text[:start]))
    return set(range(before, before + len(words(text[start:end]))))


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(4000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    pool = [fresh(rng.randrange(44, 130)) for _ in range(12)]
    out = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(0, 4)):
            p = list(rng.choice(pool))
            w += fresh(rng.randrange(0, 200)) + p[rng.randrange(0, 8) :]
        w += fresh(rng.randrange(0, 90))
        # one long line, hard-wrapped lines of any width, or blank lines anywhere
        wrap = rng.choice([10**9, rng.randrange(2, 14), 40])
        out.append((i, "".join(x + ("\n" if k % wrap == wrap - 1 else rng.choice([" ", " ", "\t ", "\n\n" if wrap == 40 else " "])) for k, x in enumerate(w))))
    return out


def found(spark, rows):
    got = runs.repeated_text(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    return [r for r in got if r.para is None], got


@pytest.mark.parametrize("seed", [1, 2])
def test_every_repeated_run_is_found_whole(spark, monkeypatch, seed):
    monkeypatch.setattr(runs, "CHUNK", 3000)
    same = "z " * 60
    rows = texts(seed) + [(100, None), (101, ""), (102, "only " * 99), (103, "twice " * 100), (104, same), (105, "퟿𝒳 " + same.replace(" ", "\n"))]
    own, _ = found(spark, rows)
    text = dict(rows)
    got, kept, gone = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in own:
        part = covered(text[r.doc_id], r.start, r.end)
        assert len(part) >= L and r.copies > 1
        got[r.doc_id] |= part
        (gone if r.removed else kept)[r.doc_id] |= part
        assert words(text[r.first_doc_id][r.first_start :])[:L] == words(text[r.doc_id][r.start :])[:L]
        assert (r.first_doc_id, r.first_start) < (r.doc_id, r.start) if r.removed else r.first_doc_id == r.doc_id
    want = brute(rows)
    assert got == {rows[i][0]: w for i, w in want.items()}
    assert len(want) > 30 and 102 not in got and got[103] == set(range(100))
    assert kept[104] == set(range(60)) and not gone[104] and gone[105] == set(range(1, 61))
    # what stays when the removed words go still holds every repeated gram's words somewhere
    left = {x for i, t in rows for k, x in enumerate(words(t or "")) if k not in gone[i]}
    assert left == {x for _, t in rows for x in words(t or "")}


def test_null_and_repeated_ids(spark):
    rng = random.Random(5)
    run = " ".join(f"v{rng.randrange(900)}" for _ in range(55))
    own, _ = found(spark, [(None, "a b " + run), (7, run + " c"), (7, run + " c"), (9, "x\n" + run)])
    assert sorted((str(r.doc_id), r.start, r.first_doc_id, r.first_start, r.copies, r.removed) for r in own) == sorted([("None", 4, 7, 0, 4, True), ("7", 0, 7, 0, 4, False), ("7", 0, 7, 0, 4, True), ("9", 2, 7, 0, 4, True)])


def test_empty_and_no_repeats(spark):
    assert runs.repeated_text(spark.createDataFrame([], SCHEMA)).count() == 0
    assert runs.repeated_text(spark.createDataFrame([(1, "one two three", "x", 1)], SCHEMA)).count() == 0
