"""The list of peers that may connect; what isn't on it may not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def setup(spark: SparkSession, peers: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(p,) for p in dict.fromkeys(peers or [])], "peer string")


def set_peer(acl: DataFrame, peer: str, allowed: bool) -> DataFrame:
    others = acl.where(F.col("peer") != peer)
    return others.union(acl.sparkSession.createDataFrame([(peer,)], "peer string")) if allowed else others


def allowed(connections: DataFrame, acl: DataFrame, column: str = "peer") -> DataFrame:
    return connections.join(acl.select(F.col("peer").alias("_peer")), F.col(column) == F.col("_peer"), "left_semi")


def is_allowed(connections: DataFrame, acl: DataFrame, column: str = "peer") -> DataFrame:
    known = acl.select(F.col("peer").alias("_peer")).distinct()
    return connections.join(known, F.col(column) == F.col("_peer"), "left").withColumn("allowed", F.col("_peer").isNotNull()).drop("_peer")
