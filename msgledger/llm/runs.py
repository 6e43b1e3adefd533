"""Operator 10: runs of words that repeat verbatim, wherever lines break and whatever stands around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgledger.llm.common import grouped_map, key_filter, map_arrow, passes, shuffle_parts, sorted_groups, text_or_empty, written
from msgledger.llm.paragraphs import repeated_passages
from msgledger.llm.tokens import Words, gram_hash, words_of_column

#: A gram has 50 words; its seed is the smallest hash among the 26 half grams in it, so equal grams have equal seeds.
HALF = 25
GRAM = 2 * HALF
#: Bytes of text whose grams are looked at at once, of several documents or of one.
CHUNK = 1 << 20


def grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, position, gram, seed)`` of every GRAM consecutive words of each document, in order."""
    if len(w.hash) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    sums = w.sums()
    half, gram = gram_hash(sums, HALF), gram_hash(sums, GRAM)
    least, reach = half, 1
    while 2 * reach <= HALF + 1:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    m = len(gram)
    seed = np.minimum(least[:m], least[HALF + 1 - reach :][:m])
    doc = w.doc
    at = np.flatnonzero(doc[:m] == doc[GRAM - 1 :])
    return doc[at], at - w.offset[doc[at]], gram[at], seed[at]


def _seeds(doc: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct seeds and how often each stands; a stretch of more than HALF + 1 grams has its seed more than once."""
    first = np.ones(len(seed), bool)
    first[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    times = 1 + (np.diff(np.append(at, len(seed))) > HALF + 1)
    u, back = np.unique(seed[at], return_inverse=True)
    return u.view(np.int64), np.bincount(back, times, len(u)).astype(np.int64)


def _bases(doc: np.ndarray, pos: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """For each gram its own position, or that of an equal one before in the document that it overlaps."""
    order = np.lexsort((pos, gram, doc))
    d, p, g = doc[order], pos[order], gram[order]
    base = p.copy()
    for i in (np.flatnonzero((g[1:] == g[:-1]) & (d[1:] == d[:-1])) + 1).tolist():
        if p[i] < base[i - 1] + GRAM:
            base[i] = base[i - 1]
    out = np.empty_like(base)
    out[order] = base
    return out


# ---------------------------------------------------------------- whole numbers in order of their places, packed
def _pack(z: zstandard.ZstdCompressor, *columns: np.ndarray) -> bytes:
    """Differences of each column's numbers, by byte planes, compressed."""
    x = np.stack([np.diff(c.astype(np.int64), prepend=np.int64(0)) for c in columns])
    return z.compress(x.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes())


def _unpack(z: zstandard.ZstdDecompressor, raw: bytes, columns: int) -> np.ndarray:
    x = np.frombuffer(z.decompress(raw), np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1)
    return np.cumsum(np.ascontiguousarray(x).view(np.int64)[:, :, 0], axis=1)


_FOUND = "part int, chunk bigint, docs array<bigint>, rids array<bigint>, packed binary, gram array<bigint>"


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, start, end, first_doc_id, first_start, copies, removed)``: all words that lie in a repeated run of 50 words or more.

    A gram of 50 words (A-Z lower-cased, white space doesn't matter) repeats when it stands at two places or more
    that don't overlap, in one document or several. Every such gram is found, at every place. A row is a stretch
    of repeated grams at consecutive words, cut where the document of their first places changes (smallest
    doc_id, of repeated rows the first read, then place), and where ``removed``, not at the first place, changes: so each
    removed word stands at an earlier place among the same 50 words. ``start``, ``end`` and ``first_start``
    are in code points; ``copies`` is the most places that one of the stretch's grams stands at. Rows of one
    document may overlap by 49 words.

    Null and empty texts have no words. A null doc_id counts as larger than all others. Repeated rows
    are copies. Columns besides doc_id and text are not read; an empty table, or one without repeats, gives no rows.

    Grams are compared only where their seeds repeat, and then by 64 bits of a hash of their words. A chunk of documents
    sends each of its distinct grams once, with its first place, to the task that compares it, however often the chunk has
    it; the answer comes back to the chunk by position. So a gram of any share of the texts is one entry of each chunk.
    """
    spark = docs.sparkSession
    parts, limit = shuffle_parts(spark), CHUNK

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words_of_column(b.column(0), limit):
                doc, _, _, seed = grams(w)
                u, n = _seeds(doc, seed)
                yield pa.record_batch([pa.array(u), pa.array(n)], names=["seed", "n"])

    seeds = map_arrow(docs.select(text_or_empty().alias("text")), sow, "seed bigint, n bigint")
    seeds = written(seeds.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed"), "seeds")
    several = spark.sparkContext.broadcast(key_filter(seeds, "seed"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk a row of its places (``part`` is null), and one of its distinct grams for each part that compares them."""
        z = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for w in words_of_column(b.column(2), limit):
                doc, pos, gram, seed = grams(w)
                at = np.flatnonzero(passes(several.value, seed))
                if not len(at):
                    continue
                doc, pos, gram = doc[at], pos[at], gram[at]
                word = w.offset[doc] + pos
                start, end = w.start[word], w.end[word + GRAM - 1]
                base = _bases(doc, pos, gram)
                rids, ids = b.column(0).slice(w.first, len(w.size)), b.column(1).slice(w.first, len(w.size))
                rank = np.empty(len(w.size), np.int64)
                rank[np.lexsort((rids.to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(w.size))
                _, back = np.unique(gram, return_inverse=True)
                order = np.lexsort((pos, rank[doc], back))
                first = order[np.flatnonzero(np.append(True, np.diff(back[order]) > 0))]
                n = np.bincount(back, base == pos).astype(np.int64)
                # distinct grams are numbered by part, then by their first place
                part = (gram[first] % np.uint64(parts)).astype(np.int64)
                by = np.lexsort((first, part))
                to = np.empty(len(by), np.int64)
                to[by] = np.arange(len(by))
                first, part, n = first[by], part[by], n[by]
                cuts = np.flatnonzero(np.append(True, np.diff(part) > 0))
                ends = np.append(cuts[1:], len(part))
                packed = [_pack(z, doc, pos, start, end, base, to[back])]
                null, doc_id = ids.is_null().to_numpy(zero_copy_only=False)[doc[first]], ids.fill_null(0).to_numpy()[doc[first]]
                rid = rids.to_numpy()[doc[first]]
                packed += [_pack(z, np.arange(lo, hi), *(x[lo:hi] for x in (null, doc_id, rid, pos[first], start[first], n))) for lo, hi in zip(cuts.tolist(), ends.tolist(), strict=True)]
                k = len(cuts) + 1
                # the chunk's documents are listed with its places alone
                lists = pa.array(np.append(np.int32(0), np.full(k, len(w.size), np.int32)))
                own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0, 0], ends)).astype(np.int32)), pa.array(gram[first].view(np.int64)))
                yield pa.record_batch(
                    [pa.array([None, *part[cuts].tolist()], pa.int32()), pa.array([number] * k, pa.int64()), pa.ListArray.from_arrays(lists, ids), pa.ListArray.from_arrays(lists, rids), pa.array(packed, pa.binary()), own],
                    names=["part", "chunk", "docs", "rids", "packed", "gram"],
                )
                number += 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part of each chunk, where its repeated grams stand first and how often; parts are balanced, as a chunk has a gram once."""
        z, back = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for t in sorted_groups(batches, ["part"]):
            sizes = pa.compute.list_value_length(t["gram"]).to_numpy()
            at, null, doc_id, rid, pos, start, n = np.concatenate([_unpack(z, x, 7) for x in t["packed"].to_pylist()], axis=1)
            gram = t["gram"].combine_chunks().flatten().to_numpy()
            order = np.lexsort((pos, rid, doc_id, null, gram))
            g = gram[order]
            lo = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(lo, len(g)))
            copies, first = np.empty(len(g), np.int64), np.empty(len(g), np.int64)
            copies[order] = np.repeat(np.add.reduceat(n[order], lo), size)
            first[order] = np.repeat(order[lo], size)
            chunk, cuts = t["chunk"].to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
            for i in range(len(sizes)):
                k = cuts[i] + np.flatnonzero(copies[cuts[i] : cuts[i + 1]] > 1)
                if len(k):
                    f = first[k]
                    yield pa.record_batch([pa.array([chunk[i]], pa.int64()), pa.array([_pack(back, at[k], null[f], doc_id[f], rid[f], pos[f], start[f], copies[k])], pa.binary())], names=["chunk", "answer"])

    def resolve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        own = t.filter(t["answer"].is_null())
        answers = t["answer"].drop_null().to_pylist()
        if not answers:
            return
        doc, pos, start, end, base, gram = _unpack(z, own["packed"][0].as_py(), 6)
        ids, rid = own["docs"][0].values, own["rids"][0].values.to_numpy()
        known = np.zeros((7, int(gram.max()) + 1), np.int64)
        for x in answers:
            x = _unpack(z, x, 7)
            known[:, x[0]] = x
        at = np.flatnonzero(known[6, gram] > 1)
        doc, pos, start, end, base = (x[at] for x in (doc, pos, start, end, base))
        _, null, first_doc, first_rid, first_pos, first_start, copies = known[:, gram[at]]
        removed = (rid[doc] != first_rid) | (base != first_pos)
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (first_rid[1:] != first_rid[:-1]) | (removed[1:] != removed[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(at)) - 1
        yield pa.record_batch(
            [ids.take(pa.array(doc[lo])), pa.array(start[lo], pa.int32()), pa.array(end[hi], pa.int32()), pa.array(first_doc[lo], pa.int64(), mask=null[lo] == 1), pa.array(first_start[lo], pa.int32()), pa.array(np.maximum.reduceat(copies, lo)), pa.array(removed[lo])],
            names=["doc_id", "start", "end", "first_doc_id", "first_start", "copies", "removed"],
        )

    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    found = written(map_arrow(base, find, _FOUND), "grams")
    asked = found.where("part IS NOT NULL").repartitionById(parts, "part").sortWithinPartitions("part")
    answers = map_arrow(asked, compare, "chunk bigint, answer binary")
    places = found.where("part IS NULL").select("chunk", "docs", "rids", "packed", F.lit(None).cast("binary").alias("answer"))
    return grouped_map(places.unionByName(answers, allowMissingColumns=True), ["chunk"], resolve, "doc_id bigint, start int, end int, first_doc_id bigint, first_start int, copies bigint, removed boolean")


def repeated_text(docs: DataFrame) -> DataFrame:
    """``repeated_passages``, exact or near, and ``repeated_runs``, which have no ``para`` and ``first_para``. Rows of the two may overlap."""
    return repeated_passages(docs).unionByName(repeated_runs(docs), allowMissingColumns=True)
