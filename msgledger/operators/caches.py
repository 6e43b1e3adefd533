"""What the caches answer, as aggregates: first value, last value, appended lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgledger.functions.codec import offset_to_char


def first_wins(pairs: DataFrame, key: str, value: str, order: str = "seq") -> DataFrame:
    return pairs.groupBy(key).agg(F.min_by(value, order).alias(value))


def last_wins(pairs: DataFrame, key: str, value: str, order: str = "seq") -> DataFrame:
    return pairs.groupBy(key).agg(F.max_by(value, order).alias(value))


def with_shard(pairs: DataFrame, offset: str = "offset") -> DataFrame:
    """One of 16 shards, by the offset's last hex digit."""
    return pairs.withColumn("shard", offset_to_char(F.col(offset)))


def look_up(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests with what the cache has under their key, null where nothing; adaptive execution broadcasts a small cache."""
    return requests.join(cache, key, "left")


def append_offsets(cached: Column, new: Column) -> Column:
    """The list after new offsets came: positive ones that it lacks are added."""
    return F.array_union(F.coalesce(cached, F.array().cast("array<bigint>")), F.filter(new, lambda x: x > 0))


def append_offsets_stopping(cached: Column, new: Column) -> Column:
    """As the cache really does it: an empty list is replaced; else new values are tried from the last to the first, up to the first that the list has. Values of 0 and below are passed over."""
    start = F.struct(cached.alias("list"), F.lit(False).alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        has = F.array_contains(acc["list"], x)
        add = ~acc["stop"] & (x > 0) & ~has
        return F.struct(F.when(add, F.array_append(acc["list"], x)).otherwise(acc["list"]).alias("list"), (acc["stop"] | ((x > 0) & has)).alias("stop"))

    appended = F.aggregate(F.reverse(new), start, step, lambda acc: acc["list"])
    return F.when(F.coalesce(F.size(cached), F.lit(0)) <= 0, new).otherwise(appended)


def contains(cached: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(cached, value), F.lit(False))
