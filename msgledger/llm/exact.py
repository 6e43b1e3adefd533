"""Operator 4: exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgledger.llm.common import keep_rows, map_arrow, shuffle_parts, text_or_empty, written

#: Runs that meet in one merge; log2(FAN_IN) rounds of a binomial tree are done at once.
FAN_IN = 4


def normalised(col: str = "text") -> Column:
    r"""The text with each run of ``[\x20\x09-\x0D]`` as one space; null as empty."""
    return F.regexp_replace(text_or_empty(col), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_sha256, n_bytes, check)`` for each row; the last two verify that equal digests come of equal texts."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised().alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("text_sha256"), F.octet_length("t").cast("bigint").alias("n_bytes"), F.xxhash64("t").alias("check")
    )


KEY = ["digest", "n_bytes", "check"]
RUN = "digest binary, n_bytes bigint, check bigint, null_id boolean, doc_id bigint, rid bigint, n bigint"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge sorted entries: of those with equal keys the first (smallest identifier) stays, with the sum of counts."""
    held: pa.RecordBatch | None = None
    names = [f.split()[0] for f in RUN.split(", ")]
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.record_batch(b.columns, names=names)  # without "not null", which differs from batch to batch
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        new = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            same = None
            for k in KEY:
                c = b.column(b.schema.get_field_index(k))
                eq = pc.equal(c.slice(1), c.slice(0, b.num_rows - 1))
                same = eq if same is None else pc.and_(same, eq)
            new[1:] = ~same.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        n = np.add.reduceat(b.column(6).to_numpy(), at)
        out = b.take(pa.array(at)).set_column(6, "n", pa.array(n, pa.int64()))
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def _merged(df: DataFrame) -> DataFrame:
    return map_arrow(df.sortWithinPartitions(*KEY, "null_id", "doc_id", "rid").select(*[f.split()[0] for f in RUN.split(", ")]), _merge, RUN)


def tree_merge(entries: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One entry for each key of ``entries`` (columns of ``RUN``): the smallest (doc_id, rid), and the sum of ``n``.

    Each partition makes a sorted run of its distinct keys. Then partitions exchange runs in rounds as in a
    binomial tree of ``fan_in``-fold merges: in round r those whose numbers differ just in digit r (base
    fan_in) share out their entries by that digit of the key's own partition, and each merges what it gets.
    So after log(partitions) rounds a key's entries have met in one partition, no partition holds more than
    its share of the keys, and however frequent a key is, it is one entry of each run.
    """
    parts, rounds = fan_in, 1
    while parts < shuffle_parts(entries.sparkSession):
        parts, rounds = parts * fan_in, rounds + 1
    goal = F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")
    run = _merged(entries)
    at = F.spark_partition_id() % parts
    for r in range(rounds):
        unit = fan_in**r
        digit = lambda c: F.floor(c / unit).cast("int") % fan_in
        run = run.withColumn("to", (at + (digit(goal) - digit(at)) * unit).cast("int")).repartitionById(parts, "to")
        run = _merged(run)
        at = F.spark_partition_id()
    return run


def exact_duplicates(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``normalised``; null counts as empty, and empty texts form a
    group like others. Of a group the row with the smallest doc_id stays; of several rows with it, the
    first read. A null doc_id counts as larger than all others (a group of only such rows has a null
    keep_id and keeps one row). An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    return _decided(docs, fan_in).drop("check")


def _decided(docs: DataFrame, fan_in: int) -> DataFrame:
    """``exact_duplicates`` and ``check``, xxhash64 of the normalised text."""
    rows = written(digests(docs).withColumn("rid", F.monotonically_increasing_id()), "digests")
    entries = rows.select(F.unhex("text_sha256").alias("digest"), "n_bytes", "check", F.col("doc_id").isNull().alias("null_id"), "doc_id", "rid", F.lit(1).cast("bigint").alias("n"))
    best = tree_merge(entries, fan_in).select(F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes", "check", F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.col("n").alias("group_size"))
    out = rows.join(best, ["text_sha256", "n_bytes", "check"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", "check")


def keep_exact(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all of its columns: of equal texts one row with the smallest doc_id.

    Of rows equal in doc_id and text one stays, the same one on a rerun. Null and empty texts are one group; an empty table gives no rows.
    """
    found = _decided(docs, fan_in)
    return keep_rows(docs, F.xxhash64(normalised()), found.select("doc_id", F.col("check").alias("key"), F.col("kept").alias("stays")))
