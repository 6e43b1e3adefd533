import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgledger.llm import quality, toxicity

VOCABULARY = ["river", "stone", "garden", "window", "market", "silver", "morning", "letter", "castle", "bridge", "winter", "harbour"]
DOCS = "doc_id bigint, text string, score string, label int, y int"


def corpus(seed, n=500):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(VOCABULARY) + rng.choice(["", "s", "ly", "ing"]) for _ in range(rng.randrange(20, 200))]
        bad, junk = rng.random() < 0.2, rng.random() < 0.25
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilefool", "dirtbag"]))
        text = " | ".join(words) if junk else " ".join(words) + "."
        docs.append((i, text))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, "s", 0, 0) for i, t in docs], DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


CASES = [(toxicity.toxicity, 2, 5, 0, 0.5), (quality.quality, 1, 4, 2, 0.7)]


@pytest.mark.parametrize(("score", "column", "folds", "fold", "threshold"), CASES)
def test_held_out_accuracy_and_edges(spark, score, column, folds, fold, threshold):
    docs, labels = corpus(column)
    edges = [(1000, None), (1001, ""), (None, "river stone"), (0, docs[0][1]), (0, docs[0][1]), (1002, "word " * 30000)]
    d, lab = frames(spark, docs + edges, labels + [(None, 1, 1), (2000, None, None), (0, *labels[0][1:])])
    rows = score(d.repartition(4), lab)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = rows.collect()
    assert len(rows) == len(docs) + len(edges)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("null" if r.doc_id is None else r.doc_id).encode()) % folds == fold) for r in rows)
    truth = {x[0]: x[column] for x in labels}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(round(r.score, 12))
    assert len(by[0]) == 1


@pytest.mark.parametrize(("score", "column", "folds", "fold", "threshold"), CASES)
def test_held_out_labels_teach_nothing(spark, score, column, folds, fold, threshold):
    docs, labels = corpus(9, 200)
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == fold else (i, q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in score(*frames(spark, docs, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_without_labels(spark):
    docs, labels = corpus(1, 20)
    for score in (toxicity.toxicity, quality.quality):
        d, lab = frames(spark, docs, [])
        assert {r.score for r in score(d, lab).collect()} == {0.0}
        none, lab = frames(spark, [], labels)
        assert score(none, lab).count() == 0


def test_keep_ordinary(spark):
    docs, labels = corpus(4)
    d, lab = frames(spark, [*docs, (900, None)], labels)
    kept = toxicity.keep_ordinary(d, lab)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    bad = {i for i, _, t in labels if t}
    assert len(ids & bad) < 0.1 * len(bad) and len(ids - bad) > 0.95 * (len(docs) - len(bad)) and 900 in ids
    assert kept.where(F.col("doc_id") == 900).first().text is None
