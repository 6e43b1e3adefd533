"""The log as a text file, and generated articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgledger import schema as S
from msgledger.functions import codec


def export(lines: DataFrame, path: str) -> None:
    """Text parts whose concatenation in the order of their names is the log: the header at offset 0, then all lines by offset."""
    spark = lines.sparkSession
    header = spark.range(1).select(F.lit(0).cast("bigint").alias("offset"), codec.encode_header(F.lit(S.ROUTE_CHARS), F.lit(S.KEY_CHARS)).alias("line"))
    whole = header.unionByName(lines.select("offset", "line"))
    whole.repartitionByRange("offset").sortWithinPartitions("offset").select("line").write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(offset, line)`` of one log file, header included, whose lines end in a line feed alone.

    Splits are read in parallel: each adds up its own lines in the order they are read, and the splits' totals, one row each, are added up and broadcast.
    """
    lines = spark.read.text(path).select("_metadata.file_block_start", F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"), (F.octet_length("value") + 1).cast("bigint").alias("bytes"))
    before = lambda col, w: F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = lines.groupBy("file_block_start").agg(F.sum("bytes").alias("total"))
    starts = totals.select(F.col("file_block_start").alias("block"), before("total", Window.orderBy("file_block_start")).alias("start"))
    own = lines.withColumn("own", before("bytes", Window.partitionBy("file_block_start").orderBy("at")))
    return own.join(F.broadcast(starts), F.col("file_block_start") == F.col("block")).select((F.col("start") + F.col("own")).alias("offset"), "line")


def header(log: DataFrame) -> DataFrame:
    return log.where("offset = 0").select(codec.decode_header(F.col("line")).alias("settings"), F.octet_length("line").alias("bytes"))


def records(log: DataFrame) -> DataFrame:
    return log.where(F.col("offset") >= S.FIRST_OFFSET)


def test_hashes(spark: SparkSession, n: int) -> DataFrame:
    # Fixed value: the text that is hashed
    text = F.concat(F.lit("test-message-"), F.col("id").cast("string"), F.lit("-12345678901234567890"))
    return spark.range(n).select(F.col("id").alias("seq"), F.sha2(text, 256).alias("hash"))


def bulk_articles(spark: SparkSession, n: int, now: int, days: int = 30) -> DataFrame:
    """Articles of test hashes: token F, arrived and dated now, to expire in 30 days."""
    return test_hashes(spark, n).select("seq", "hash", F.lit("F").alias("token"), F.lit(now).cast("bigint").alias("arrival"), F.lit(now + days * 86400).cast("bigint").alias("expires"), F.lit(now).cast("bigint").alias("date"))
