"""Operator 10: passages that documents share, by MinHash bands over paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgledger.llm.common import key_filter, map_arrow, passes, text_or_empty, written
from msgledger.llm.near import near_components
from msgledger.llm.shingles import Sketcher, mix
from msgledger.llm.tokens import Words, span_hash, span_shingles, words_of_column

#: Words that a paragraph needs to be looked at.
MIN_WORDS = 25
#: Words above which a line is looked at in pieces too, and the length to which pieces without a cut are cut.
LONG, MAX_PART = 300, 100
#: 14 bands of 4 samples: two paragraphs of similarity 0.8 share none with a chance of 6e-4, of 0.9 with 4e-7.
BANDS, ROWS = 14, 4
#: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _cuts(h: np.ndarray) -> list[int]:
    """Where long passages, given by their words' hashes, are cut: before the word whose pair with the one before has the smallest hash among MIN_WORDS to either side.

    So cuts depend on the words around them alone, and parts have MIN_WORDS words or more. Parts over
    2 * MAX_PART words, as of one word repeated, are cut every MAX_PART words.
    """
    n, r = len(h), MIN_WORDS
    at = []
    if n >= 2 * r:
        h = mix(h[:-1] * _PAIR + h[1:])  # h[i]: the pair that ends before word i + 2
        near = np.lib.stride_tricks.sliding_window_view(h, r).min(axis=1)
        i = np.arange(r, len(h) - r)
        at = (i[(h[i] < near[i - r]) & (h[i] <= near[i + 1])] + 1).tolist()
    out, last = [], 0
    for cut in [*at, n]:
        while cut - last > 2 * MAX_PART:
            last += MAX_PART
            out.append(last)
        if cut < n:
            out.append(cut)
        last = cut
    return out


def parts(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``split`` of each of the documents: document, and first word and end among the words of all, in order."""
    n = len(w.hash)
    if not n:
        return (np.empty(0, np.int64),) * 3
    doc = w.doc
    head = np.flatnonzero(np.concatenate(([True], (w.line[1:] != w.line[:-1]) | (doc[1:] != doc[:-1]))))
    tail = np.append(head[1:], n)
    size, of = tail - head, doc[head]
    short = size < MIN_WORDS
    # short lines that follow each other in a document are one passage
    new = np.concatenate(([True], ~short[1:] | ~short[:-1] | (of[1:] != of[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(head)) - 1
    lo, hi = head[first], tail[last]
    joined = last > first
    out = [(lo[~joined], hi[~joined])]
    for a, b in zip(*(x[joined | (hi - lo > LONG)].tolist() for x in (lo, hi)), strict=True):
        cuts = [0, *_cuts(w.hash[a:b]), b - a]
        if len(cuts) > 2 or w.line[a] != w.line[b - 1]:  # a long line without a cut is a part already
            out.append((np.array(cuts[:-1]) + a, np.array(cuts[1:]) + a))
    lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((-hi, lo))
    lo, hi = lo[order], hi[order]
    return doc[lo], lo, hi


def split(text: str) -> list[tuple[int, int]]:
    r"""Starts and ends, in code points, of a text's parts, from the first of its words to the end of the last.

    A line of MIN_WORDS words or more is a part; one of more than LONG words is also cut into parts. Shorter lines
    that follow each other, blank ones left out, are joined, and cut where their words say so.
    """
    return [(int(w.start[a]), int(w.end[b - 1])) for w in words_of_column(pa.array([text], pa.string())) for _, a, b in zip(*parts(w), strict=True)]


def _long_parts(w: Words, min_words: int) -> tuple[np.ndarray, ...]:
    """Document, number in it, first word, end and node of each part of ``min_words`` words or more; and the sums of hashes."""
    doc, lo, hi = parts(w)
    para = np.arange(len(doc)) - np.searchsorted(doc, doc)
    keep = hi - lo >= min_words
    doc, para, lo, hi = doc[keep], para[keep], lo[keep], hi[keep]
    sums = w.sums()
    return doc, para, lo, hi, span_hash(sums, lo, hi).view(np.int64), sums


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, para, start, end, n_words, node, bands)`` of each paragraph of ``min_words`` words or more.

    ``node``: 64 bits of a hash of its words, A-Z lower-cased. Bands are given once for each node and chunk of documents.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = Sketcher(bands, rows)
        for b in batches:
            for w in words_of_column(b.column(1)):
                doc, para, lo, hi, node, sums = _long_parts(w, min_words)
                if not len(doc):
                    continue
                _, first = np.unique(node, return_index=True)
                first.sort()
                keys = sk.many_band_keys(sk.many_samples(*span_shingles(sums, lo[first], hi[first])))
                has = np.zeros(len(node), np.int32)
                has[first] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), np.cumsum(has, dtype=np.int32))), pa.array(keys.ravel()))
                yield pa.record_batch(
                    [b.column(0).take(pa.array(doc + w.first)), *(pa.array(x.astype(np.int32)) for x in (para, w.start[lo], w.end[hi - 1], hi - lo)), pa.array(node), lists],
                    names=["doc_id", "para", "start", "end", "n_words", "node", "bands"],
                )

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(base, sign, "doc_id bigint, para int, start int, end int, n_words int, node bigint, bands array<bigint>")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, num: int = NUM, den: int = DEN, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, para, start, end, first_doc_id, first_para, first_start, copies, removed)``: each paragraph that repeats, exactly or nearly.

    A paragraph is a part as ``split`` gives them (a line, joined short lines, a piece of a long line), of ``min_words``
    words or more; ``para`` counts all parts, ``start`` and ``end`` are in code points. Paragraphs are linked when their words (A-Z
    lower-cased) are equal or den * intersection >= num * union of their 5-word shingles, confirmed on full sets;
    components of links are removed but for the first paragraph (smallest doc_id, then place), which all
    of them name. ``copies`` counts the component's paragraphs, also those within one document.

    Null and empty texts have no paragraphs. A null doc_id counts as larger than all others. Repeated rows
    are copies: all but the first read are removed. Columns besides doc_id and text are not read; an empty
    table, or one without repeats, gives no rows.
    """
    found = written(occurrences(docs, min_words, bands, rows).withColumn("rid", F.monotonically_increasing_id()), "paragraphs")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "para", "start", "rid")).alias("m")

    def fetch(members: DataFrame) -> DataFrame:
        bits = docs.sparkSession.sparkContext.broadcast(key_filter(members, "node"))

        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                for w in words_of_column(b.column(0)):
                    _, _, lo, hi, node, sums = _long_parts(w, min_words)
                    at = [i for i in np.flatnonzero(passes(bits.value, node)).tolist() if not (node[i] in seen or seen.add(node[i]))]
                    if not at:
                        continue
                    s, n = span_shingles(sums, lo[at], hi[at])
                    raw = [np.unique(x).tobytes() for x in np.split(s, np.cumsum(n)[:-1])]
                    yield pa.record_batch([pa.array(node[at]), pa.array(raw, pa.binary())], names=["node", "shingles"])

        sets = map_arrow(docs.select(text_or_empty().alias("text")), shingles, "node bigint, shingles binary")
        # one set of each paragraph, whatever number of tasks met it
        one = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
        return members.join(one, "node").withColumn("odd", F.lit(None).cast("binary"))

    signed = found.where(F.size("bands") > 0).select("node", "bands", F.col("n_words").alias("n"))
    comp = near_components(signed, fetch, 0, num, den)
    # equal paragraphs are one node, counted in each task before the shuffle
    classes = found.groupBy("node").agg(least, F.count("*").alias("n")).join(comp, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # written, so that the joins below read plain shuffles, of which large components and groups of copies are split
    classes = written(classes, "classes")
    best = written(classes.groupBy("label").agg(F.min("m").alias("m"), F.sum("n").alias("copies")).where("copies > 1"), "components")
    of_node = written(classes.select("node", "label").join(best, "label").select("node", "m", "copies"), "nodes")
    out = found.select("doc_id", "para", "start", "end", "node", "rid").join(of_node, "node")
    return out.select("doc_id", "para", "start", "end", F.col("m.doc_id").alias("first_doc_id"), F.col("m.para").alias("first_para"), F.col("m.start").alias("first_start"), "copies", (F.col("rid") != F.col("m.rid")).alias("removed"))
