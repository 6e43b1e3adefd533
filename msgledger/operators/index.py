"""The index from hash prefixes to offsets in the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgledger import schema as S
from msgledger.functions import codec, routing

WIDTH = S.ROUTE_CHARS + S.KEY_CHARS


def build(logged: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(pfx, key, offsets)`` from ``logged(hash, offset)``: offsets of each key in ascending order, repeats kept.

    Keys of 10 characters meet hardly more than a few offsets; a narrower width makes collisions.
    """
    k = routing.full_key(F.col("hash"), width)
    keyed = logged.select(F.substring(k, 1, S.ROUTE_CHARS).alias("pfx"), F.substring(k, S.ROUTE_CHARS + 1, width).alias("key"), "offset")
    return keyed.groupBy("pfx", "key").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))


def merge(index: DataFrame, more: DataFrame) -> DataFrame:
    """Both indexes' offsets under each key; a null list is revived as an empty one."""
    both = index.unionByName(more.select(*index.columns)).withColumn("offsets", F.coalesce("offsets", F.array().cast("array<bigint>")))
    return both.groupBy("pfx", "key").agg(F.array_sort(F.flatten(F.collect_list("offsets"))).alias("offsets"))


def rebuild(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """The index from the log alone; lines without a readable hash have no entry."""
    return build(lines.select(codec.line_hash(F.col("line")).alias("hash"), "offset").where("hash IS NOT NULL"), width)


def entries(index: DataFrame) -> DataFrame:
    """One row for each positive offset of each key."""
    return index.select("pfx", "key", F.explode(F.filter("offsets", lambda x: x > 0)).alias("offset"))


def lookup(index: DataFrame, hash_: str, width: int = WIDTH) -> DataFrame:
    """The offsets of one hash's key. Prefix and key are both given, and of an index of ``write`` its directory, so that files and row groups are skipped."""
    k = hash_[:width]
    if "pfx_hi" in index.columns:
        index = index.where(F.col("pfx_hi").cast("string") == k[:1])
    return index.where((F.col("pfx") == k[: S.ROUTE_CHARS]) & (F.col("key") == k[S.ROUTE_CHARS :])).select("pfx", "key", "offsets").limit(1)


def write(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet in 16 directories by the first hex digit, sorted by key within files; never one directory for each prefix."""
    (index.withColumn("pfx_hi", F.substring("pfx", 1, 1)).repartitionByRange("pfx_hi", "pfx", "key").sortWithinPartitions("pfx", "key").write.mode(mode).partitionBy("pfx_hi").parquet(path))
