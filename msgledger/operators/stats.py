"""Counters, shard statistics and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgledger import schema as S
from msgledger.functions import routing


def counters(named: DataFrame, value: Column | None = None) -> DataFrame:
    """``(name, value)``: how often each name occurs, or the sum of what it adds."""
    return named.groupBy("name").agg(F.sum(F.lit(1) if value is None else value).cast("bigint").alias("value"))


def counter(named: DataFrame, name: str, value: Column | None = None) -> DataFrame:
    """One counter; 0 if nothing counted."""
    return named.where(F.col("name") == name).agg(F.coalesce(F.sum(F.lit(1) if value is None else value), F.lit(0)).cast("bigint").alias("value"))


def over_shards(counts: DataFrame) -> DataFrame:
    """Sums by name of ``counts(shard, name, value)``."""
    return counts.groupBy("name").agg(F.sum("value").cast("bigint").alias("value"))


def shard_balance(hashes: DataFrame) -> DataFrame:
    """``(mode, db_index, rows, tables)``: rows of each database and how many of its tables have any, in every mode."""
    h = F.col("hash")
    parts = [hashes.select(F.lit(m.mode).alias("mode"), routing.db_index(h, m.mode).alias("db_index"), routing.table_name(h, m.mode).alias("table_name")) for m in routing.MODES]
    by_table = reduce(DataFrame.union, parts).groupBy("mode", "db_index", "table_name").agg(F.count("*").alias("rows"))
    return by_table.groupBy("mode", "db_index").agg(F.sum("rows").cast("bigint").alias("rows"), F.count("*").alias("tables"))


def rate(events: DataFrame, ts: str = "ts", seconds: int = S.TICK_SECONDS) -> DataFrame:
    """``(start, n, per_second)`` of each tumbling window that has any events; start in epoch seconds.

    The same plan runs over a stream with a watermark.
    """
    counted = events.groupBy(F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")).agg(F.count("*").alias("n"))
    return counted.select(F.unix_seconds(F.col("window.start")).alias("start"), "n", F.format_string("%.2f", F.col("n") / float(seconds)).alias("per_second"))
