"""Operator 7: document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgledger.llm.toxicity import held_out, sample, scored

FOLDS, HELD, THRESHOLD = 4, 2, 0.7
#: Labelled documents of each label that the model is fitted on; chosen by a hash of the doc_id.
SAMPLE = 3000
#: Bytes of a passage; each byte of a text is in one.
PASSAGE = 400
HIDDEN, ATTENTION, EPOCHS, BATCH = 24, 12, 30, 64

#: Classes of bytes: other control, space, newline, lower, upper, digit, sentence marks, exclamation, bars, symbols, quotes and brackets, other marks, beyond ASCII.
CLASSES = 13


def _classes() -> np.ndarray:
    at = np.zeros(256, np.int64)
    at[[9, 32]], at[[10, 13]] = 1, 2
    at[97:123], at[65:91], at[48:58], at[128:] = 3, 4, 5, 12
    for k, marks in ((6, b".,;:"), (7, b"!?"), (8, b"|\\<>"), (9, b"#$%&*@^~+="), (10, b"\"'`()[]{}"), (11, b"-_/")):
        at[list(marks)] = k
    return at


_CLASS = _classes()


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of each text, and how many passages each text has (an empty one has one, of zeros).

    Shares of the byte classes and of their pairs, how many of the words differ, repeat the one before,
    or are capitals alone, and the words' mean length.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n = np.array([max(1, -(-len(r) // PASSAGE)) for r in raw])
    joined = np.frombuffer(b"".join(r + b"\x00" * (k * PASSAGE - len(r)) for r, k in zip(raw, n.tolist(), strict=True)), np.uint8)
    whole = joined.reshape(-1, PASSAGE)
    pairs = np.empty((len(whole), CLASSES**2), np.float32)
    for lo in range(0, len(whole), 2048):
        c = _CLASS[whole[lo : lo + 2048]]
        row = np.arange(len(c))[:, None] * CLASSES**2
        pairs[lo : lo + len(c)] = np.bincount((row + c[:, :-1] * CLASSES + c[:, 1:]).ravel(), minlength=len(c) * CLASSES**2).reshape(len(c), -1)
    c = whole
    filled = np.count_nonzero(whole, axis=1)
    single = pairs.reshape(len(c), CLASSES, CLASSES).sum(axis=2)
    size = np.maximum(filled, 1)[:, None]
    words = np.zeros((len(c), 5), np.float32)
    i = 0
    for r, k in zip(raw, n.tolist(), strict=True):
        for lo in range(0, k * PASSAGE, PASSAGE):
            w = r[lo : lo + PASSAGE].split()
            if w:
                m = len(w)
                words[i] = len(set(w)) / m, sum(map(bytes.__eq__, w[1:], w)) / m, sum(map(bytes.isupper, w)) / m, (len(r[lo : lo + PASSAGE]) - m) / m / 10, np.log1p(m) / 5
            i += 1
    share = np.concatenate([single[:, 1:], pairs[:, CLASSES:]], axis=1) / size
    return np.concatenate([np.sqrt(share), words], axis=1).astype(np.float32), n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """An encoder of passages, gated attention over a document's passages, and a classifier of their weighted mean."""

    p: dict[str, np.ndarray]
    centre: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, first: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["We"] + p["be"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}

    def score(self, texts: list[str]) -> np.ndarray:
        x, n = passages(texts)
        return self.forward((x - self.centre) / self.scale, np.cumsum(n) - n, n)["y"].astype(np.float64)


def fit(texts: list[str], labels: np.ndarray, shares: tuple[float, float] | None = None, seed: int = 5) -> Model:
    """Stochastic gradients (Adam) of the log loss of documents; passages have no labels of their own.

    ``shares``: how frequent labels 0 and 1 are among all learnable rows, where the texts hold another mixture.
    """
    x, n = passages(texts)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    x = (x - centre) / scale
    first = np.cumsum(n) - n
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"We": init(d, HIDDEN), "be": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "b": np.zeros((), np.float32)}
    m = Model(p, centre, scale)
    have = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())], float)
    want = np.array(shares, float) if shares else have
    weight = want / have / (want / have * have).sum() * len(labels)
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            k = n[docs]
            rows = np.repeat(first[docs] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            xb, fb, yb = x[rows], np.cumsum(k) - k, labels[docs]
            f = m.forward(xb, fb, k)
            err = ((f["y"] - yb) * weight[yb] / len(docs)).astype(np.float32)
            dz = err[:, None] * p["c"]
            per = np.repeat(dz, k, axis=0)
            da = (per * f["h"]).sum(axis=1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, fb), k))
            dtg = de[:, None] * p["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * per + dt @ p["V"].T + dg @ p["U"].T
            dh *= 1 - f["h"] ** 2
            grads = {"We": xb.T @ dh + 1e-4 * p["We"], "be": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ err + 1e-4 * p["c"], "b": err.sum()}
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS)
            for key, g in grads.items():
                a, v = mom[key]
                a += 0.1 * (g - a)
                v += 0.001 * (g * g - v)
                p[key] -= np.asarray(rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8), np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[Model | None, float]:
    """The model of the labels ``quality`` outside the held-out fold, and the share of label 1 in case there is none."""
    texts, y, counts = sample(docs, labels, "quality", ~held_out(FOLDS, HELD), most)
    base = counts[1] / sum(counts) if sum(counts) else 0.0
    if min((y == 0).sum(), (y == 1).sum()) < 8:
        return None, base
    return fit(texts, y, counts), base


def quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``: how likely its whole text is of good quality.

    Learns from rows of ``labels`` outside the held-out fold. The score depends on the text alone. Null and
    empty texts get the score of one passage of zeros; with under 8 usable labels of either kind all rows
    get the share of label 1. Null and repeated doc_ids are scored row by row. Columns besides doc_id
    and text, and doc_id, quality of labels, are not read; an empty table gives no rows.
    """
    model, base = train(docs, labels, most)
    out = scored(docs, model, base)
    return out.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
