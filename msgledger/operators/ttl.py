"""Exact admission with a fixed time to live: a key is let in again so long after it was last let in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgledger import schema as S

TTL_US = S.TTL_SECONDS * 1_000_000


def lives(events: DataFrame, ttl_us: int = TTL_US, key: str = "key", micros: str = "micros", order: str = "seq") -> DataFrame:
    """``events`` with ``since`` and ``first``: time and ``seq`` of the row that was let in last, up to each row itself.

    The first row of a key is let in, then each that is ``ttl_us`` or more after the last one let in. Keys are of any type;
    rows with a null key or time are left out. Rows are dealt by key and sorted; a task walks through its keys
    with one time in memory, so that no key's rows are gathered, but one key's rows are read by one task, as each
    answer depends on the one before.
    """
    at = [events.columns.index(x) for x in (key, micros, order)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_in, last_first = None, 0, 0
        for b in batches:
            k, t, seq = (b.column(i).to_numpy(zero_copy_only=False) for i in at)
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else [0]
            since, first = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                i = lo
                if last_key is not None and k[lo] == last_key:
                    i = lo + int(np.searchsorted(t[lo:hi], last_in + ttl_us))
                    since[lo:i], first[lo:i] = last_in, last_first
                while i < hi:
                    last_in, last_first = int(t[i]), int(seq[i])
                    j = lo + int(np.searchsorted(t[lo:hi], last_in + ttl_us))
                    since[i:j], first[i:j] = last_in, last_first
                    i = j
                last_key = k[lo]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(since), pa.array(first)], names=[*b.schema.names, "since", "first"])

    rows = events.where(F.col(key).isNotNull() & F.col(micros).isNotNull())
    schema = T.StructType([*rows.schema.fields, T.StructField("since", T.LongType()), T.StructField("first", T.LongType())])
    return rows.repartition(key).sortWithinPartitions(key, micros, order).mapInArrow(walk, schema)


def admitted(events: DataFrame, ttl_us: int = TTL_US, key: str = "key", micros: str = "micros", order: str = "seq") -> DataFrame:
    """The rows ``(seq, key, micros)`` of ``events`` that are let in; see ``lives``."""
    rows = events.select(F.col(order).cast("bigint").alias("seq"), F.col(key).alias("key"), F.col(micros).cast("bigint").alias("micros"))
    return lives(rows, ttl_us).where(F.col("seq") == F.col("first")).select("seq", "key", "micros")


def answers(events: DataFrame, ttl_us: int = TTL_US) -> DataFrame:
    """``(seq, key, answer)`` for every row of ``events(seq, key, micros, value)``: the test-and-set of the first cache.

    A row that is let in stores its value and is answered pass; others are answered the value stored. A null or empty
    key is answered invalid, a row without a time error. ``seq`` is distinct.
    """
    c = F.col
    keyless = F.coalesce(c("key").cast("string") == "", F.lit(True))
    rows = events.select("seq", "key", "micros", c("value").cast("int").alias("value"))
    living = lives(rows.where(~keyless), ttl_us)
    stored = living.where("seq = first").select(c("seq").alias("stored_seq"), c("value").alias("stored"))
    own = living.join(stored, c("first") == c("stored_seq")).select("seq", "key", F.when(c("seq") == c("first"), S.PASS).otherwise(c("stored")).alias("answer"))
    rest = rows.where(keyless | c("micros").isNull()).select("seq", "key", F.when(keyless, S.INVALID).otherwise(S.ERROR).alias("answer"))
    return own.union(rest)


def extended(events: DataFrame, ttl_us: int = TTL_US) -> DataFrame:
    """``answers`` where each hit extends the life: a row is let in if its key was quiet for ``ttl_us`` or more."""
    c = F.col
    keyless = F.coalesce(c("key").cast("string") == "", F.lit(True))
    by = Window.partitionBy("key").orderBy("micros", "seq")
    rows = events.select("seq", "key", "micros", c("value").cast("int").alias("value"))
    new = F.coalesce(c("micros") - F.lag("micros").over(by) >= ttl_us, F.lit(True))
    own = rows.where(~keyless & c("micros").isNotNull()).withColumn("new", new)
    stored = F.last(F.when(c("new"), c("value")), ignorenulls=True).over(by)
    rest = rows.where(keyless | c("micros").isNull()).select("seq", "key", F.when(keyless, S.INVALID).otherwise(S.ERROR).alias("answer"))
    return own.select("seq", "key", F.when(c("new"), S.PASS).otherwise(stored).alias("answer")).union(rest)


def cached_at(sets: DataFrame, gets: DataFrame, value: Column, ttl_us: int = TTL_US) -> DataFrame:
    """``(seq, key, value)``: what a cache with a time to live has for each of ``gets(seq, key, micros)``, null where nothing.

    ``sets(seq, key, micros, ...)``: a set of a key that is absent or expired starts a life of ``ttl_us``; ``value`` is an
    aggregate over the sets of this life before the get, such as ``F.min_by("hash", F.struct("micros", "seq"))`` where the first one's stays or
    ``F.array_distinct(F.collect_list("offset"))`` where they are appended. Of a set and a get at one time the set comes first; seqs of gets are distinct.
    """
    c = F.col
    living = lives(sets, ttl_us)
    asked = gets.select(c("seq").alias("get_seq"), c("key"), c("micros").alias("get_micros"))
    # the life that a get falls into: the last one that began before it, if it lasts until then
    began = living.where("seq = first").select("key", c("since").alias("at"), F.lit(None).cast("bigint").alias("get_seq"))
    both = began.unionByName(asked.select("key", c("get_micros").alias("at"), "get_seq"))
    last = F.last(F.when(c("get_seq").isNull(), c("at")), ignorenulls=True).over(Window.partitionBy("key").orderBy("at", c("get_seq").isNotNull(), "get_seq").rowsBetween(Window.unboundedPreceding, 0))
    of = both.withColumn("life", last).where(c("get_seq").isNotNull()).select("get_seq", c("key").alias("get_key"), c("at").alias("get_at"), F.when(c("at") < c("life") + ttl_us, c("life")).alias("life"))
    found = of.join(living, (c("get_key") == c("key")) & (c("life") == c("since")) & (c("micros") <= c("get_at")), "left")
    return found.groupBy("get_seq", "get_key").agg(value.alias("value")).select(c("get_seq").alias("seq"), c("get_key").alias("key"), "value")
