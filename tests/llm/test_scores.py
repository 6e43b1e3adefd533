"""Scores of the models' queries against plain loops over the same weights, on whole tables."""

import math
from collections import Counter

import pytest
import zstandard

from msgledger.llm import quality, queries, toxicity


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def lengths(content, windows):
    """Compressed length of each window by a fresh compressor."""
    p = zstandard.ZstdCompressionParameters(compression_level=1, window_log=13, hash_log=16, chain_log=16, search_log=5, min_match=5, target_length=1, strategy=zstandard.STRATEGY_GREEDY, write_checksum=0, write_content_size=0, write_dict_id=0)
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
    return [len(c.compress(w)) for w in windows]


def toxic_score(m, text):
    raw = b" ".join([b"", *(text or "").lower().encode().split(), b""])
    step = toxicity.WINDOW - toxicity.OVERLAP
    n = 1
    while n * step + toxicity.OVERLAP < len(raw):
        n += 1
    windows = [toxicity.LEAD + raw[i * step : i * step + toxicity.WINDOW] for i in range(n)]
    blank = b"\xff" * (len(m.strict) - len(toxicity.LEAD)) + toxicity.LEAD
    pairs = [(m.ordinary, m.toxic), (blank, m.strict)]
    x = [math.log(n)]
    for without, own in pairs:
        gains = [a - b for a, b in zip(lengths(without, windows), lengths(own, windows), strict=True)]
        up = sum(g for g in gains if g > 0)
        hit, strong = sum(g >= 1 for g in gains), sum(g >= 3 for g in gains)
        x += [max(gains), math.log1p(up), math.sqrt(up / n), math.log1p(hit), math.sqrt(hit / n), math.log1p(strong), min(strong, 1), math.sqrt(strong / n)]
    x = [(a - b) / c for a, b, c in zip(x, m.centre, m.scale, strict=True)]
    terms = [1.0, *x] + [max(-25.0, min(25.0, x[i] * x[j])) for i in range(len(x)) for j in range(i, len(x))]
    return sigmoid(sum(a * b for a, b in zip(terms, m.weights, strict=True)))


MARKS = {6: b".,;:", 7: b"!?", 8: b"|\\<>", 9: b"#$%&*@^~+=", 10: b"\"'`()[]{}", 11: b"-_/"}


def byte_class(b):
    if b in b"\t ":
        return 1
    if b in b"\n\r":
        return 2
    if b >= 128:
        return 12
    c = chr(b)
    if c.isalpha():
        return 3 if c.islower() else 4
    if c.isdigit():
        return 5
    return next((k for k, marks in MARKS.items() if b in marks), 0)


def passage(part):
    """Features of one passage, which counts as filled up with NUL bytes."""
    size = quality.PASSAGE
    filled = max(1, sum(b != 0 for b in part))
    c = [byte_class(b) for b in part] + [0] * (size - len(part))
    pairs = Counter(zip(c, c[1:], strict=False))
    first = Counter(c[:-1])
    k = quality.CLASSES
    share = [first[i] for i in range(1, k)] + [pairs[i, j] for i in range(1, k) for j in range(k)]
    w = part.split()
    words = [0.0] * 5
    if w:
        m = len(w)
        words = [len(set(w)) / m, sum(a == b for a, b in zip(w, w[1:], strict=False)) / m, sum(x.isupper() for x in w) / m, (len(part) - m) / m / 10, math.log1p(m) / 5]
    return [math.sqrt(s / filled) for s in share] + words


def layer(x, w, b):
    return [math.tanh(sum(x[i] * w[i][j] for i in range(len(x)) if x[i]) + b[j]) for j in range(len(b))]


def quality_score(m, text):
    raw = (text or "").encode()
    p = {k: v.tolist() for k, v in m.p.items()}
    encoded, weights = [], []
    for lo in range(0, max(1, len(raw)), quality.PASSAGE):
        x = [(a - b) / c for a, b, c in zip(passage(raw[lo : lo + quality.PASSAGE]), m.centre.tolist(), m.scale.tolist(), strict=True)]
        h = layer(x, p["We"], p["be"])
        t = layer(h, p["V"], [0.0] * quality.ATTENTION)
        g = [sigmoid(sum(h[i] * p["U"][i][j] for i in range(len(h)))) for j in range(quality.ATTENTION)]
        encoded.append(h)
        weights.append(math.exp(sum(a * b * c for a, b, c in zip(t, g, p["w"], strict=True))))
    z = [sum(w * h[j] for w, h in zip(weights, encoded, strict=True)) / sum(weights) for j in range(quality.HIDDEN)]
    return sigmoid(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["b"])


CASES = [(toxicity, queries.op3_toxicity, toxic_score, 1e-9, 0.5), (quality, queries.op7_quality, quality_score, 2e-4, 0.7)]


@pytest.mark.parametrize(("module", "query", "brute", "error", "threshold"), CASES)
def test_whole_table_against_plain_loops(spark, sf_dir, module, query, brute, error, threshold):
    docs, labels = (queries.table(spark, sf_dir, name) for name in ("documents", "labels"))
    model, _ = module.train(docs, labels)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = {r.doc_id: r for r in query(spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    for i, text in texts:
        want = brute(model, text)
        assert abs(rows[i].score - want) < error, i
        assert rows[i].predicted == int(rows[i].score >= threshold)


@pytest.mark.parametrize(("module", "query", "brute", "error", "threshold"), CASES)
def test_odd_texts_against_plain_loops(spark, sf_dir, module, query, brute, error, threshold):
    docs, labels = (queries.table(spark, sf_dir, name) for name in ("documents", "labels"))
    model, _ = module.train(docs, labels)
    texts = ["", " ", "\n\n", "x", "a" * 400, "a" * 401, "Straße 12 — 𝒳!" * 90, "\x00 \x01 tab\tend", "A " * 30_000]
    for text, got in zip(texts, model.score(texts), strict=True):
        assert abs(got - brute(model, text)) < error, text[:20]
