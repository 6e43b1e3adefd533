"""Lines of the add protocol, from a socket or any stream of text, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgledger.functions import codec


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of parsed lines; for tests, as Spark's socket source can't replay."""
    return parsed(spark.readStream.format("socket").option("host", host).option("port", port).load().select(F.col("value").alias("line")))


def parsed(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Code and fields of each ``line``; the same for tables and streams."""
    return lines.select("line", codec.parse_wire(F.col("line"), strict).alias("p")).select("line", "p.*")


def encoded(articles: DataFrame) -> DataFrame:
    c = F.col
    fields = codec.wire_fields(c("hash"), c("token"), c("arrival"), c("expires"), c("date"))
    return articles.withColumn("line", codec.wire_line(fields))
