"""The append-only log: validation, byte offsets, lines, totals and point reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgledger import schema as S
from msgledger.functions import codec

#: Records of one bucket of the prefix sum; a bucket is one window's partition.
BUCKET = 250_000
#: Quantiles that the buckets are cut at; more records make the buckets larger.
CUTS = 65_536


def status(hash_: Column, token: Column) -> Column:
    """0 for a valid record, else the code that it is answered with.

    Empty hash or token: error. Under 64 characters: invalid. A routing prefix that isn't hexadecimal: retry, as
    no table has it. Upper-case hex: error, as it would never match.
    """
    empty = F.coalesce(hash_ == "", F.lit(True)) | F.coalesce(token == "", F.lit(True))
    return (
        F.when(empty, S.ERROR)
        .when(F.length(hash_) < S.HASH_CHARS, S.INVALID)
        .when(~F.substring(hash_, 1, S.ROUTE_CHARS).rlike("^[0-9a-fA-F]{3}$"), S.RETRY)
        .when(hash_ != F.lower(hash_), S.ERROR)
        .otherwise(0)
    )


def validate(articles: DataFrame, now: Column | None = None, normalise: bool = False) -> DataFrame:
    """``articles`` with ``status`` and an arrival of 0 or null replaced by now; ``normalise`` lower-cases hashes first.

    Rows with a status other than 0 are the quarantine; the log takes the others.
    """
    now = F.unix_timestamp() if now is None else now
    hash_ = F.lower("hash") if normalise else F.col("hash")
    out = articles.withColumn("hash", hash_).withColumn("status", status(F.col("hash"), F.col("token")))
    return out.withColumn("arrival", F.when(F.coalesce(F.col("arrival"), F.lit(0)) == 0, now).otherwise(F.col("arrival")).cast("bigint"))


def line() -> Column:
    """An article's line, of its columns."""
    return codec.line(*[F.col(x) for x in ("hash", "token", "arrival", "expires", "date")])


def with_lines(articles: DataFrame) -> DataFrame:
    return articles.withColumn("line", line())


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def with_offsets(lines: DataFrame, order: str = "seq", base: int = S.FIRST_OFFSET, bucket: int = BUCKET, line: Column | None = None) -> DataFrame:
    """``lines`` with the byte ``offset`` of each, in the order of a numeric column without repeats or nulls.

    ``line``: what a line will be, for rows that don't hold theirs yet and are spared carrying it through the sort.

    Two phases instead of one window over all rows: quantiles of the order cut it into buckets of about
    ``bucket`` records, CUTS at most, each bucket sums its own lines, and the buckets' totals, one row each,
    are added up and broadcast. Nothing but the count and the quantiles reaches the driver.
    """
    size, to, own, at, start = _fresh(lines, "bytes", "bucket", "own", "at", "start")
    sized = lines.withColumn(size, codec.line_bytes(F.col("line") if line is None else line))
    n = lines.count()
    parts = max(1, min(CUTS, -(-n // bucket)))
    before = lambda col, w: F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if parts == 1:
        return sized.withColumn("offset", before(size, Window.orderBy(order)) + F.lit(base)).drop(size)
    cuts = np.array(sorted(set(lines.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts)).first()[0])))

    @F.arrow_udf("bigint")  # binary search; the column alone goes through Arrow
    def find(x: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, x.to_numpy(zero_copy_only=False)), pa.int64())

    cut = sized.withColumn(to, find(F.col(order)))
    starts = cut.groupBy(to).agg(F.sum(size).alias(own)).select(F.col(to).alias(at), before(own, Window.orderBy(to)).alias(start))
    placed = cut.withColumn(own, before(size, Window.partitionBy(to).orderBy(order))).join(F.broadcast(starts), F.col(to) == F.col(at))
    return placed.withColumn("offset", F.col(start) + F.col(own) + F.lit(base)).drop(size, to, own, at, start)


def totals(lines: DataFrame) -> DataFrame:
    """Lines and bytes that the log holds after its header."""
    return lines.agg(F.count("*").alias("lines"), F.coalesce(F.sum(codec.line_bytes(F.col("line"))), F.lit(0)).alias("bytes"))


def hash_at(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` with the hash that the log has at their offset (equi-join), null where it has none that is readable."""
    found = log.select(F.col("offset").alias("_at"), codec.line_hash(F.col("line")).alias("logged_hash"))
    return candidates.join(found, F.col("offset") == F.col("_at"), "left").drop("_at")


def line_at(log: DataFrame, offset: int) -> DataFrame:
    """The line at an offset; a filter that reaches the scan."""
    return log.where(F.col("offset") == offset).select("offset", "line")


def expired(articles: DataFrame, now: Column) -> DataFrame:
    """Records whose expiry has passed; 0 never does. The reference stores expiries and doesn't evaluate them: an extension."""
    return articles.where((F.col("expires") > 0) & (F.col("expires") <= now))
