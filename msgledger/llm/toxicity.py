"""Operator 3: toxicity by compression distance to toxic and to ordinary text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgledger.llm.common import map_arrow, text_or_empty
from msgledger.llm.shingles import WordHashes, shingle_set, words_of

#: Labelled documents of each label that the model is fitted on; chosen by a hash of the doc_id.
SAMPLE = 4000
#: Bytes of one such text, and of all of a label's; longer texts teach nothing, but are scored like others.
TEXT_BYTES, LABEL_BYTES = 1 << 20, 1 << 26
#: Bytes of a dictionary, bytes of a window and of the overlap of two windows.
DICTIONARY, WINDOW, OVERLAP = 4096, 48, 14
#: Lengths of the word beginnings that a dictionary may hold.
STEMS = range(3, 11)
#: A beginning is typical of a label if its share of that label's documents is so many times the other's,
#: and the difference so many standard errors.
LIFT, ERRORS = 3.0, 5.0
#: ... and hardly ever met under the other label, if it is so many times.
STRICT = 25.0
#: It must occur in that share of the label's documents, so that a few copies of one document don't make it typical.
SHARE = 0.015
#: Windows begin with this; both dictionaries hold it, so that zstandard never stores a window as it is.
LEAD = bytes(range(128, 192))
#: Stands between segments, so that no match goes over two.
APART = b"\xfe"


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def _stems(text: str) -> set[bytes]:
    out = set()
    for w in set(_words(text)):
        out.update([b" " + w[:k] for k in STEMS if k < len(w)])
        out.add(b" " + w)
    return out


def _dictionaries(parts: list[list[bytes]], shared: list[bytes]) -> list[bytes]:
    """For each label: the shared segments, then those typical of it, both at the same distance from the end."""
    typical = []
    for p in parts:
        out, size = [], 0
        for s in p:
            if size + len(s) > DICTIONARY // 2:
                break
            out.append(APART + s)
            size += len(s) + 1
        typical.append(b"".join(reversed(out)))
    longest = max(map(len, typical))
    front = APART.join(shared)[: DICTIONARY // 2]
    return [front + b"\xff" * (longest - len(t)) + t + LEAD for t in typical]


def _longest(scored: list[tuple[float, bytes]], most: int) -> list[bytes]:
    """Segments by score, without those that begin or continue one taken before."""
    out: list[bytes] = []
    begun: set[bytes] = set()
    for _, s in scored:
        if s in begun or any(s[:k] in begun and s[:k] in taken for taken in (set(out),) for k in range(2, len(s))):
            continue
        out.append(s)
        begun.update(s[:k] for k in range(3, len(s) + 1))
        if len(out) >= most:
            break
    return out


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, bytes]:
    """Contents of the dictionaries: word beginnings typical of one label, after those frequent in both.

    The third has only those typical of toxic text that ordinary text hardly has, and nothing frequent.
    """
    df = [Counter(), Counter()]
    for label, texts in enumerate((ordinary, toxic)):
        for t in texts:
            df[label].update(_stems(t))
    n = [len(ordinary) + 1, len(toxic) + 1]
    both = df[0] + df[1]
    least = max(6, (n[0] + n[1]) // 1000)
    found: list[list] = [[], [], [], []]
    for s, k in both.items():
        if k < least:
            continue
        p = [(df[0][s] + 0.5) / n[0], (df[1][s] + 0.5) / n[1]]
        mean = (df[0][s] + df[1][s] + 1) / (n[0] + n[1])
        error = np.sqrt(mean * (1 - min(mean, 0.999)) * (1 / n[0] + 1 / n[1]))
        label = int(p[1] > p[0])
        if p[label] > LIFT * p[1 - label] and p[label] - p[1 - label] > ERRORS * error and df[label][s] >= max(8, SHARE * n[label]):
            found[label].append((p[label] * np.log(p[label] / p[1 - label]) * (1 + len(s) / 16), s))
            if label and p[1] > STRICT * p[0]:
                found[3].append(found[1][-1])
        elif p[1 - label] * LIFT > p[label]:
            found[2].append((min(p) * len(s), s))
    ordered = [_longest(sorted(f, reverse=True), 250) for f in found]
    return (*_dictionaries([ordered[1], ordered[0]], ordered[2]), _dictionaries([ordered[3]], [])[0])


def without_copies(texts: list[str]) -> list[int]:
    """Numbers of the texts that don't share a fifth of their word shingles with earlier ones: a copied text would count its words as often as it is copied."""
    hashes, seen, out = WordHashes(), set(), []
    for i, t in enumerate(texts):
        s = shingle_set(words_of(t), hashes)
        s = set((s if len(s) < 200 else s[s % np.uint64(8) == 0]).tolist())
        if 5 * len(s & seen) <= len(s):
            out.append(i)
        seen |= s
    return out


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    strict: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    @cached_property
    def compressors(self) -> tuple:
        # windows are too short for entropy coding of literals: what a dictionary saves are the matches alone, of 5 bytes or more
        p = zstandard.ZstdCompressionParameters(compression_level=1, window_log=13, hash_log=16, chain_log=16, search_log=5, min_match=5, target_length=1, strategy=zstandard.STRATEGY_GREEDY, write_checksum=0, write_content_size=0, write_dict_id=0)
        out = []
        for content in (self.ordinary, self.toxic, self.strict, b"\xff" * (len(self.strict) - len(LEAD)) + LEAD):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        return tuple(out)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text, how many bytes its windows save by the toxic dictionary against the ordinary one, and by the strict one against none."""
        raw = [b" ".join([b"", *_words(t), b""]) for t in texts]
        n = np.array([max(1, -(-(len(r) - OVERLAP) // (WINDOW - OVERLAP))) for r in raw])
        ordinary, toxic, strict, blank = (c.compress for c in self.compressors)
        gain, sure = [], []
        for r, k in zip(raw, n.tolist(), strict=True):
            for lo in range(0, k * (WINDOW - OVERLAP), WINDOW - OVERLAP):
                w = LEAD + r[lo : lo + WINDOW]
                plain = len(ordinary(w))
                g = plain - len(toxic(w))
                gain.append(g)
                sure.append(len(blank(w)) - len(strict(w)))
        first = np.cumsum(n) - n
        out = [np.log(n)]
        for g in (np.array(gain, float), np.array(sure, float)):
            total = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
            up = total(np.maximum(g, 0))
            hit, strong = total((g >= 1) * 1.0), total((g >= 3) * 1.0)
            out += [np.maximum.reduceat(g, first), np.log1p(up), np.sqrt(up / n), np.log1p(hit), np.sqrt(hit / n), np.log1p(strong), np.minimum(strong, 1), np.sqrt(strong / n)]
        return np.stack(out, axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        x = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(_quadratic(x) @ self.weights, -30, 30)))


def _quadratic(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, np.clip(x[:, i] * x[:, j], -25, 25)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    c = np.ones(len(y)) if weight is None else weight
    reg = ridge * np.eye(x.shape[1])
    reg[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p) + 1e-9)[:, None]).T @ x + reg, x.T @ (c * (y - p)) - reg @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: np.ndarray, shares: tuple[float, float] | None = None) -> Model:
    """Dictionaries from one half of the texts and the thresholds' calibration from the other, and the reverse.

    ``shares``: how frequent labels 0 and 1 are among all learnable rows, where the texts hold another mixture.
    """
    own = without_copies(texts)
    texts, labels = [texts[i] for i in own], labels[own]
    fold = np.arange(len(texts)) % 2
    xs, ys = [], []
    pick = lambda want, keep: [t for t, y, k in zip(texts, labels, keep, strict=True) if y == want and k]
    for f in (0, 1):
        m = Model(*train_dictionaries(pick(1, fold != f), pick(0, fold != f)), np.empty(0), np.zeros(1), np.ones(1))
        own = [t for t, k in zip(texts, fold == f, strict=True) if k]
        if own:
            xs.append(m.features(own))
            ys.append(labels[fold == f])
    x, y = np.concatenate(xs), np.concatenate(ys)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    have = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())], float)
    want = np.array(shares, float) if shares else have
    weight = (want / have / (want / have).mean())[y.astype(int)]
    w = fit_logistic(_quadratic((x - centre) / scale), y, 3.0, weight)
    return Model(*train_dictionaries(pick(1, fold >= 0), pick(0, fold >= 0)), w, centre, scale)


def held_out(folds: int, fold: int):
    """Column: is crc32 of doc_id as text, modulo ``folds``, equal to ``fold``? A null doc_id counts as the text "null"."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % folds == fold


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable, most: int = SAMPLE) -> tuple[list[str], np.ndarray, tuple[float, float]]:
    """Texts and labels of ``most`` learnable rows of each label at most, those with the smallest hash of the doc_id, and how many rows each label has.

    Only the sample's texts reach the driver, one for each doc_id (the smallest), LABEL_BYTES of each label at most. Rows with a null
    doc_id, text or label, and texts over TEXT_BYTES, teach nothing; of differing labels of a doc_id the larger counts.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).where("y IN (0, 1)").where(learnable)
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = own.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).union(own.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # one text of each doc_id, however often it occurs
    found = docs.where(F.octet_length("text") <= TEXT_BYTES).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))  # of ``most`` rows
    found = found.withColumn("upto", upto).where(F.col("upto") <= LABEL_BYTES).drop("upto")
    rows = found.toArrow().to_pydict()
    order = sorted(range(len(rows["y"])), key=lambda i: rows["doc_id"][i])
    return [rows["text"][i] for i in order], np.array([rows["y"][i] for i in order], int), (counts.get(0, 0), counts.get(1, 0))


def scored(docs: DataFrame, model, base: float) -> DataFrame:
    """``(doc_id, score)`` for each row by ``model.score`` over whole texts; ``base`` where a model can't be fitted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                s = np.full(part.num_rows, base) if m is None else m.score(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")), score, "doc_id bigint, score double")


FOLDS, HELD, THRESHOLD = 5, 0, 0.5


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[Model | None, float]:
    """The model of the labels ``toxic`` outside the held-out fold, and the share of label 1 in case there is none."""
    texts, y, counts = sample(docs, labels, "toxic", ~held_out(FOLDS, HELD), most)
    base = counts[1] / sum(counts) if sum(counts) else 0.0
    if min((y == 0).sum(), (y == 1).sum()) < 8:
        return None, base
    return fit(texts, y, counts), base


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``: how likely its whole text is toxic.

    Learns from rows of ``labels`` outside the held-out fold. The score depends on the text alone. Null and
    empty texts get the score of a text that saves nothing; with under 8 usable labels of either kind all
    rows get the share of label 1. Null and repeated doc_ids are scored row by row. Columns besides doc_id
    and text, and doc_id, toxic of labels, are not read; an empty table gives no rows.
    """
    model, base = train(docs, labels, most)
    out = scored(docs, model, base)
    return out.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, with all of its columns; no shuffle of texts."""
    model, base = train(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                s = np.full(part.num_rows, base) if m is None else m.score([t or "" for t in part.column(at).to_pylist()])
                yield pa.record_batch(part.filter(pa.array(s < THRESHOLD)).columns, names=names)

    return map_arrow(docs, keep, docs.schema)
