"""Operator 2: BPE encoding through a table of distinct words, and decoding through a table of pieces."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgledger.llm.common import map_arrow, shuffle_parts, text_or_empty, written

#: Words of the distinct-word table that are broadcast, and the bytes and ids one of them may have: 30 MB at most.
HEAD_WORDS, HEAD_BYTES, HEAD_IDS = 250_000, 40, 20
#: Distinct words that a task counts before it passes on those it has met FREQUENT times.
COUNTED, FREQUENT = 200_000, 3
#: Documents whose word numbers are packed together.
CHUNK = 128


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON, read on the driver only; a vocabulary's size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Lazy:
    """A broadcast value that a task builds when it first needs it, and lets go of at its end: workers stay, and do other things next."""

    def __init__(self, make: Callable, raw: object):
        self.make, self.raw, self.built = make, raw, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    def get(self):
        if self.built is None:
            self.built = self.make(self.raw)
        return self.built

    def release(self) -> None:
        self.built = None


def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


def _words(text: str) -> list[bytes]:
    r"""Parts between ASCII white space. For a tokenizer that drops white space before it splits further, a text's ids are its words' ids in order."""
    return text.encode().split()


def frequent_words(docs: DataFrame) -> DataFrame:
    """``(word, n)``: words that some task met often, with how often such tasks met them; counted in tasks before any shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush() -> pa.RecordBatch:
            often = [(w, n) for w, n in c.items() if n >= FREQUENT]
            return pa.record_batch([pa.array([w for w, _ in often], pa.binary()), pa.array([n for _, n in often], pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0):
                c.update(_words(text.as_py()))
                if len(c) >= COUNTED:
                    yield flush()
                    c.clear()
        yield flush()

    return map_arrow(docs.select(text_or_empty().alias("text")), count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _as_stored(docs: DataFrame) -> bool:
    """Does each read give the same partitions? Rows of files do, unless a shuffle, or Python code, stands between."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return "FileScan" in plan and not re.search("Exchange|Python|Arrow|Pandas|Union|Sample|ExistingRDD", plan)


def _encode(t, words: list[bytes]) -> list[np.ndarray]:
    out = []
    for lo in range(0, len(words), 1000):
        out += [np.array(e.ids, np.int32) for e in t.encode_batch_fast([w.decode() for w in words[lo : lo + 1000]], add_special_tokens=False)]
    return out


def head_table(docs: DataFrame, tokenizer: Broadcast) -> pa.Table:
    """``(word, ids)`` of frequent words, HEAD_WORDS at most, each encoded once, in order of frequency."""
    words = written(frequent_words(docs).where(F.octet_length("word") <= HEAD_BYTES).withColumn("level", F.floor(F.log2("n") * 16)), "frequent")
    counts = sorted(((r[0], r[1]) for r in words.groupBy("level").count().collect()), reverse=True)  # 16 rows for each doubling of n
    total, least = 0, None
    for lv, n in counts:
        if total + n > HEAD_WORDS:
            break
        total, least = total + n, lv

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _encode(tokenizer.value.get(), b.column(0).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x.tobytes() if len(x) <= HEAD_IDS else None for x in ids], pa.binary())], names=["word", "n", "ids"])
        tokenizer.value.release()

    chosen = words.where(F.col("level") >= least) if least is not None else words.limit(0)
    return map_arrow(chosen.select("word", "n"), encode, "word binary, n bigint, ids binary").where("ids IS NOT NULL").toArrow().sort_by([("n", "descending"), ("word", "ascending")])


class _Head:
    def __init__(self, value: tuple[bytes, np.ndarray, bytes, np.ndarray]):
        text, ends, ids, id_ends = value
        self.text, self.ends, self.n = text, ends, len(ends)
        self.ids = np.frombuffer(ids, np.int32)
        self.starts = np.concatenate(([0], id_ends)).astype(np.int64)

    @cached_property
    def index(self) -> dict[bytes, int]:
        """Number of each word; for the tasks that split texts."""
        starts = np.concatenate(([0], self.ends))[:-1]
        return {self.text[lo:hi]: i for i, (lo, hi) in enumerate(zip(starts.tolist(), self.ends.tolist(), strict=True))}


def _packed(t: pa.Table) -> tuple[bytes, np.ndarray, bytes, np.ndarray]:
    words, ids = t["word"].to_pylist(), t["ids"].to_pylist()
    return b"".join(words), np.cumsum([len(w) for w in words], dtype=np.int64), b"".join(ids), np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)


def encode(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` for each row: the ids of the whole text without special tokens added.

    For tokenizers that drop white space. Each distinct word is encoded once: frequent ones for a broadcast
    table of bounded size, joined on each task's side; each other one in the task that all its
    places are sent to, from where its ids come back by position. Chunks of documents are packed: their
    words' numbers go to where the rare words' ids meet them.

    A null text counts as empty and has no ids; special tokens' strings in a text are those tokens, as in
    the library. Null and repeated doc_ids are kept, row by row; an empty table gives no rows. Columns besides
    doc_id and text are not read. ``docs`` is read three times in the same partitions: it is written first unless
    it is a table's rows as they stand there.
    """
    spark = docs.sparkSession
    if not _as_stored(docs):
        docs = written(docs.select("doc_id", "text"), "texts")
    sc = spark.sparkContext
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    tokenizer = sc.broadcast(Lazy(_tokenizer, tokenizer_json))
    head = sc.broadcast(Lazy(_Head, _packed(head_table(docs, tokenizer))))
    parts = shuffle_parts(spark)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[int], list[int], list[bytes]]]:
        """Number, doc_ids, words of each document, numbers of all words, and rare words: numbers from ``n`` on are theirs."""
        known = head.value.get()
        get, n = known.index.get, known.n
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                at: list[int] = []
                sizes = []
                rest: dict[bytes, int] = {}
                for text in b.column(1).slice(lo, CHUNK):
                    ws = _words(text.as_py())
                    own = [get(w, -1) for w in ws]
                    if -1 in own:
                        own = [x if x >= 0 else n + rest.setdefault(w, len(rest)) for x, w in zip(own, ws, strict=True)]
                    at += own
                    sizes.append(len(own))
                yield number, b.column(0).slice(lo, CHUNK), sizes, at, list(rest)
                number += 1
        head.value.release()

    def check(rest: list[bytes]) -> int:
        return xxhash.xxh3_64_intdigest(b" ".join(rest)) >> 1

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for number, _, _, _, rest in chunks(batches):
            of = np.fromiter((xxhash.xxh3_64_intdigest(w, 7) % parts for w in rest), np.int64, len(rest))
            order = np.argsort(of, kind="stable").astype(np.int32)
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            groups = np.split(order, cuts) if len(rest) else []
            words = [z.compress(b" ".join([rest[i] for i in g.tolist()])) for g in groups]
            k = len(groups)
            yield pa.record_batch(
                [pa.array([int(of[g[0]]) for g in groups], pa.int32()), pa.array([number] * k, pa.int64()), pa.array([check(rest)] * k, pa.int64()), pa.array([g.tobytes() for g in groups], pa.binary()), pa.array(words, pa.binary())],
                names=["part", "number", "rest", "pos", "words"],
            )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer.value.get()
        z, back = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        known: dict[bytes, np.ndarray] = {}
        for b in batches:
            lists = [z.decompress(x).split(b" ") for x in b.column(4).to_pylist()]
            new = list({w for ws in lists for w in ws if w not in known})
            known.update(zip(new, _encode(t, new), strict=True))
            sizes, ids = [], []
            for ws in lists:
                own = [known[w] for w in ws]
                sizes.append(np.array([len(x) for x in own], np.int32).tobytes())
                ids.append(back.compress(np.concatenate(own).astype(np.int32).tobytes()))
            yield pa.record_batch([b.column(1), b.column(2), b.column(3), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["number", "rest", "pos", "sizes", "ids"])
            if len(known) > COUNTED:
                known.clear()
        tokenizer.value.release()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for number, doc_ids, sizes, at, rest in chunks(batches):
            # byte planes of the words' numbers, as the higher ones are nearly constant
            planes = np.array(at, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.record_batch(
                [pa.array([number], pa.int64()), pa.array([check(rest)], pa.int64()), pa.array([len(rest)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([sizes], pa.list_(pa.int32())), pa.array([z.compress(planes)], pa.binary())],
                names=["p_number", "p_rest", "n_rest", "doc_ids", "n_words", "packed"],
            )

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.get()
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for r in range(b.num_rows):
                n_rest, n_words, raw, rest = (b.column(i)[r].as_py() for i in (0, 2, 3, 4))
                at = np.frombuffer(z.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
                ids, lengths = _join(at, known, n_rest, rest or [], z)
                word_ends = np.concatenate(([0], np.cumsum(lengths)))
                ends = word_ends[np.concatenate(([0], np.cumsum(n_words)))]
                yield pa.record_batch([b.column(1)[r].values, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])
        head.value.release()

    found = map_arrow(base, rare, "part int, number bigint, rest bigint, pos binary, words binary").repartitionById(parts, "part")
    found = map_arrow(found, encoded, "number bigint, rest bigint, pos binary, sizes binary, ids binary")
    found = found.groupBy("number", "rest").agg(F.collect_list(F.struct("pos", "sizes", "ids")).alias("found"))  # as many as partitions at most
    whole = map_arrow(base, packed, "p_number bigint, p_rest bigint, n_rest int, doc_ids array<bigint>, n_words array<int>, packed binary")
    both = whole.join(found, (F.col("number") == F.col("p_number")) & (F.col("rest") == F.col("p_rest")), "left").select("n_rest", "doc_ids", "n_words", "packed", "found")
    return map_arrow(both, resolved, "doc_id bigint, ids array<int>")


def _join(at: np.ndarray, known: _Head, n_rest: int, rest: list[dict], z: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the numbered words, and how many each has: numbers below ``known.n`` are of the broadcast words, others of ``rest`` by position."""
    if sum(len(r["pos"]) // 4 for r in rest) != n_rest:
        raise ValueError("a chunk's rare words are missing: its documents were read in another order")
    begin = np.concatenate((known.starts[:-1], np.zeros(n_rest, np.int64)))
    n = np.concatenate((np.diff(known.starts), np.zeros(n_rest, np.int64)))
    flat, end = [known.ids], len(known.ids)
    for r in rest:
        pos = np.frombuffer(r["pos"], np.int32) + known.n
        n[pos] = np.frombuffer(r["sizes"], np.int32)
        begin[pos] = end + np.cumsum(n[pos]) - n[pos]
        flat.append(np.frombuffer(z.decompress(r["ids"]), np.int32))
        end += len(flat[-1])
    flat = np.concatenate(flat)
    lengths = n[at]
    return flat[np.repeat(begin[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))], lengths


def pieces(tokenizer_json: str) -> list[str]:
    """Piece of each id; its size is the vocabulary's."""
    t = _tokenizer(tokenizer_json)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def decode(encoded: DataFrame, tokenizer_json: str, ids: str = "ids", out: str = "decoded", keep: bool = False) -> DataFrame:
    """``encoded`` with ``out`` in place of ``ids``, or besides it (``keep``): the pieces of the ids, joined as the library joins those of a tokenizer without decoder.

    The piece table is broadcast (its size is the vocabulary's) and joined by id in each batch, where ids are the pieces' places. Null
    ids give null, no ids an empty text.
    """
    table = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer_json))
    fields = [f for f in encoded.schema.fields if keep or f.name != ids]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` string"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.array(table.value, pa.string())
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                lists = part.column(part.schema.get_field_index(ids))
                found = pa.compute.take(piece, lists.flatten())
                ends = np.append(0, np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))
                texts = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ")
                texts = pa.compute.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.record_batch([part.column(part.schema.get_field_index(n)) for n in names] + [texts], names=[*names, out])

    return map_arrow(encoded, joined, schema)
