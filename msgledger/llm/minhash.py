"""Operator 5: near-duplicate documents by MinHash bands and odd sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgledger.llm.common import keep_rows, key_filter, map_arrow, passes, text_or_empty, written
from msgledger.llm.near import near_components
from msgledger.llm.shingles import Sketcher
from msgledger.llm.tokens import Words, span_shingles, words_of_column

#: 28 bands of 6 samples: two sets of similarity 0.85 share none with a chance of 2e-6, of 0.3 share one with a chance of 0.02.
BANDS, ROWS = 28, 6
#: 100 * intersection >= 85 * union.
NUM, DEN = 85, 100


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sets(w: Words) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's shingles; without words none."""
    ends = w.offset
    has = np.flatnonzero(w.size)
    s, n = span_shingles(w.sums(), ends[has], ends[has + 1])
    out = [np.empty(0, np.uint64)] * len(w.size)
    for i, x in zip(has.tolist(), np.split(s, np.cumsum(n)[:-1]) if len(has) else [], strict=True):
        out[i] = np.unique(x)
    return out


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, h, n_shingles, digest, node, bands, odd)``, a row for each row of ``docs``.

    ``h`` is xxhash64 of the text and ``digest`` 128 bits over the shingle set; documents of one set are
    one ``node`` (64 of these bits). A set that a chunk of documents has again isn't sampled again.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = Sketcher(bands, rows)
        for b in batches:
            for w in words_of_column(b.column(2)):
                sets = _sets(w)
                digest = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
                n = np.array([len(s) for s in sets], np.int64)
                first: dict[bytes, int] = {}
                own = [i for i, d in enumerate(digest) if d is not None and first.setdefault(d, i) == i]
                keys, odd = np.empty((0, bands), np.int64), []
                if own:
                    m = sk.many_samples(np.concatenate([sets[i] for i in own]), n[own])
                    keys, odd = sk.many_band_keys(m), [sk.odd_sketch(x) for x in m]
                row = {i: k for k, i in enumerate(own)}
                of = np.array([row[first[d]] for d in digest if d is not None], np.int64)
                ends = np.append(0, np.cumsum((n > 0) * bands)).astype(np.int32)
                ids, h = (b.column(c).slice(w.first, len(n)) for c in (0, 1))
                yield pa.record_batch(
                    [ids, h, pa.array(n), pa.array(digest, pa.binary()), pa.array([None if d is None else _node(d) for d in digest], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[of].ravel())), pa.array([None if d is None else odd[row[first[d]]] for d in digest], pa.binary())],
                    names=["doc_id", "h", "n_shingles", "digest", "node", "bands", "odd"],
                )

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))
    return map_arrow(base, sign, "doc_id bigint, h bigint, n_shingles bigint, digest binary, node bigint, bands array<bigint>, odd binary")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept, h, chosen``.

    A document's set has the 5-word shingles of its whole text, A-Z lower-cased. Documents are linked
    when den * intersection >= num * union, confirmed on full sets. ``component_id`` is the smallest
    doc_id reachable, ``kept`` tells doc_id = component_id, and ``chosen`` marks exactly one row of each
    component (of several rows with the smallest doc_id, the first read), ``h`` is xxhash64 of the text.

    Null and empty texts have no shingles and are linked with nothing: each is its own component. A null
    doc_id counts as larger than all others; a component of only such rows has a null component_id, which
    counts as kept. Repeated rows are linked like copies. Columns besides doc_id and text are not read.
    """
    sk = Sketcher(bands, rows)
    sig = written(signatures(docs, bands, rows).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "rid"))
    sets = sig.where("n_shingles > 0")

    def fetch(found: DataFrame) -> DataFrame:
        # copies are one row of each task before they meet
        one = sets.groupBy("node").agg(F.min(F.struct("rid", "h", "odd")).alias("one")).join(found, "node")
        one = written(one.select("node", "cluster", "blocks", "block", F.col("one.h").alias("h"), F.col("one.odd").alias("odd")), "members")
        bits = docs.sparkSession.sparkContext.broadcast(key_filter(one, "h"))

        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                h = b.column(0).to_numpy()
                at = [i for i in np.flatnonzero(passes(bits.value, h)).tolist() if not (h[i] in seen or seen.add(h[i]))]
                for w in words_of_column(b.column(1).take(pa.array(at, pa.int64()))):
                    sets = [s for s in _sets(w) if len(s)]
                    yield pa.record_batch([pa.array([_node(xxhash.xxh3_128_digest(s)) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

        text = docs.select(F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))
        # one set of each node, whatever number of tasks met it
        found_sets = map_arrow(text, shingles, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
        return one.join(found_sets, "node")

    comp = near_components(sets.select("node", "bands", F.col("n_shingles").alias("n")), fetch, sk.differing_bits(num, den), num, den)
    classes = sets.groupBy("node").agg(least.alias("m")).join(comp, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # written, so that the joins below read plain shuffles, of which large components and groups of copies are split
    classes = written(classes, "classes")
    best = written(classes.groupBy("label").agg(F.min("m").alias("m")), "components")
    of_node = written(classes.select("node", "label").join(best, "label").select("node", F.col("m.doc_id").alias("component_id"), F.col("m.rid").alias("chosen_rid")), "nodes")
    out = sig.join(of_node, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "h", F.coalesce(F.col("chosen_rid") == F.col("rid"), F.lit(True)).alias("chosen"))


def keep_near(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, all of ``docs``' columns; rows without words all stay.

    Of rows equal in doc_id and text one stays, the same one on a rerun. An empty table gives no rows.
    """
    found = near_duplicates(docs, **params)
    return keep_rows(docs, F.xxhash64(text_or_empty()), found.select("doc_id", F.col("h").alias("key"), F.col("chosen").alias("stays")))
