"""Test-and-set with a fixed time to live, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from msgledger import schema as S


class Lock(StatefulProcessor):
    """Keeps when each key was last let in and the value stored then, until a timer ends its life.

    Rows of one batch are taken in order of time; a key's rows of one batch are held together. A row older than the
    last one let in isn't let in: late rows don't change answers that were given.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("micros", LongType()), StructField("value", IntegerType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, stored = self.last.get() if self.last.exists() else (None, None)
        begun = last
        batch = pd.concat(list(rows)).sort_values(["micros", "seq"])
        answer = []
        for micros, value in zip(batch["micros"].tolist(), batch["value"].tolist(), strict=True):
            if last is None or micros >= last + self.ttl_us:
                last, stored = int(micros), int(value)
                answer.append(S.PASS)
            else:
                answer.append(stored)
        if last != begun:
            if begun is not None:
                self.handle.deleteTimer(self._end(begun))
            self.last.update((last, stored))
            self.handle.registerTimer(self._end(last))
        yield batch[["seq", "key", "micros"]].assign(answer=answer)

    def _end(self, micros: int) -> int:
        """The first millisecond at which the life has ended."""
        return -(-(micros + self.ttl_us) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"seq": pd.Series(dtype="int64"), "key": pd.Series(dtype=object), "micros": pd.Series(dtype="int64"), "answer": pd.Series(dtype="int32")})

    def close(self) -> None:
        pass


def answers(stream: DataFrame, ttl_us: int, late: str = "0 seconds") -> DataFrame:
    """``(seq, key, micros, answer)`` of a stream ``(seq, key, micros, value)``; as ``operators.ttl.answers`` has them, with empty keys left out.

    Keys are of any type. A life's state goes when the watermark, ``late`` behind the latest time, passes its end; rows that come later than
    that are dropped. Needs the RocksDB state store.
    """
    rows = stream.where(F.coalesce(F.col("key").cast("string") != "", F.lit(False))).select("seq", "key", "micros", F.col("value").cast("int").alias("value"), F.timestamp_micros("micros").alias("ts"))
    kind = rows.schema["key"].dataType
    out = StructType([StructField("seq", LongType()), StructField("key", kind), StructField("micros", LongType()), StructField("answer", IntegerType())])
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(statefulProcessor=Lock(ttl_us), outputStructType=out, outputMode="Append", timeMode="EventTime")


def admitted(stream: DataFrame, ttl_us: int, late: str = "0 seconds") -> DataFrame:
    """The rows of a stream ``(seq, key, micros)`` that are let in; see ``answers``."""
    return answers(stream.withColumn("value", F.lit(0)), ttl_us, late).where(F.col("answer") == S.PASS).select("seq", "key", "micros")
