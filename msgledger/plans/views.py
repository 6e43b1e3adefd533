"""Articles and offers made of the driver's ``events`` table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgledger.functions import codec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, hash, arrival)``: user, event type and day are what repeats."""
    text = F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.sha2(text, 256).alias("hash"), F.unix_seconds("ts").alias("arrival"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, token, arrival)``: what the other fields of an article follow from."""
    token = F.when(F.col("event_type") == "error", "X").when(F.col("event_type") == "purchase", "M").otherwise("F")
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), token.alias("token"), F.unix_seconds("ts").alias("arrival"))


def fields() -> dict[str, Column]:
    """An article's fields, of the columns of its stem: hashes are distinct; every third article never expires."""
    seq, arrival = F.col("seq"), F.col("arrival")
    return {
        "hash": F.sha2(seq.cast("string"), 256),
        "token": F.col("token"),
        "arrival": arrival,
        "expires": F.when(seq % 3 == 0, F.lit(0).cast("bigint")).otherwise(arrival + 86400 * (seq % 90)),
        "date": arrival - 3600,
    }


def stem_line(**other: Column) -> Column:
    """The line of an article, of the columns of its stem, with other fields where given."""
    return codec.line(*(fields() | other).values())


def arts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, hash, token, arrival, expires, date)``."""
    return stems(spark, sf_dir).select("seq", *[v.alias(k) for k, v in fields().items()])


SECONDS = "(epoch_us(ts) // 1000000)"

OFFERS = f"""offers AS (SELECT event_id AS seq, sha256(user_id || '-' || event_type || '-' || strftime(ts, '%Y-%m-%d')) AS hash, {SECONDS}::BIGINT AS arrival FROM events)"""

ARTS = f"""arts AS (SELECT event_id AS seq, sha256(event_id::VARCHAR) AS hash,
  CASE event_type WHEN 'error' THEN 'X' WHEN 'purchase' THEN 'M' ELSE 'F' END AS token, {SECONDS}::BIGINT AS arrival,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE {SECONDS} + 86400 * (event_id % 90) END::BIGINT AS expires, ({SECONDS} - 3600)::BIGINT AS date FROM events)"""

LINES = r"""lines AS (SELECT *, '{' || hash || '}' || chr(9) || printf('%010d', arrival) || '~' || CASE WHEN expires > 0 THEN printf('%010d', expires) ELSE '----------' END
  || '~' || printf('%010d', date) || chr(9) || token AS line FROM arts),
logged AS (SELECT *, (4096 + coalesce(sum(strlen(line) + 1) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM lines)"""


def index_sql(name: str, source: str, width: int) -> str:
    return f"""{name} AS (SELECT hash[1:3] AS pfx, hash[4:{width}] AS "key", list("offset" ORDER BY "offset") AS offsets FROM {source} GROUP BY ALL)"""


def crc_sql(key: str, text: str, source: str) -> str:
    """A table ``crcs`` of ``key`` and the CRC-32 of ``text``, byte by byte, with the 256 remainders made by the polynomial's bits."""
    return f"""remainders AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
crc_bytes AS (SELECT {key}, t, list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM {source}, remainders),
crcs AS (SELECT {key}, printf('%x', xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)) AS crc FROM crc_bytes)"""
