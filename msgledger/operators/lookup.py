"""Has a hash been seen? Index candidates verified on the log, and the same as semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgledger import schema as S
from msgledger.functions import codec, routing
from msgledger.operators import index as ix


def request_status(hash_: Column, offset: Column) -> Column:
    """What a request is answered before any lookup: invalid for a short hash, error for an offset that is neither -1 nor positive, added for an insert; null for a search."""
    return (
        F.when(F.coalesce(F.length(hash_), F.lit(0)) < S.HASH_CHARS, S.INVALID)
        .when(offset > 0, S.ADDED)
        .when(F.coalesce(offset, F.lit(0)) != S.SEARCH, S.ERROR)
    )


def _pfx(hash_: Column, width: int) -> Column:
    return F.substring(routing.full_key(hash_, width), 1, S.ROUTE_CHARS)


def _key(hash_: Column, width: int) -> Column:
    return F.substring(routing.full_key(hash_, width), S.ROUTE_CHARS + 1, width)


def _keyed(requests: DataFrame, width: int) -> DataFrame:
    return requests.withColumn("pfx", _pfx(F.col("hash"), width)).withColumn("key", _key(F.col("hash"), width))


def verified(requests: DataFrame, index: DataFrame, lines: DataFrame, width: int = ix.WIDTH, hash_: Column | None = None, line: Column | None = None) -> DataFrame:
    """``(seq, hash, status)``: dupes if any candidate's line has the whole hash, else pass.

    ``requests(seq, hash)``, ``lines(offset, line)``. A hit under the key alone is no duplicate. A single candidate whose
    line is there but can't be read is answered retry; among several, such a one is skipped.

    ``hash_``, ``line``: what a request's hash and a logged line are, for rows that don't hold theirs and are spared carrying
    them between tasks. They are made of the rows' other columns, none of which begins with an underscore, on either side of an exchange, so
    they have to be deterministic.

    Each entry of the index reads its line once, and counts as a hit under the key of that line's hash alone; requests meet
    hits by the hash. Requests times candidates, of which narrow keys have many, are never rows. Keys that are to be answered
    retry are one row each.
    """
    asked = F.col("hash") if hash_ is None else hash_
    text = F.col("line") if line is None else line
    # null keys equal no hash's; without them the filters of both joins are the same, and the index is made once
    entries = ix.entries(index).toDF("_pfx", "_key", "_entry").where("_pfx IS NOT NULL AND _key IS NOT NULL")
    logged = codec.line_hash(text)
    read = lines.withColumn("_at", F.col("offset"))
    if line is None:
        read, logged = read.select("_at", logged.alias("_logged")), F.col("_logged")
    # under coalesce the key isn't pulled out into the exchange and the sort, where it would be made of the line again
    own = F.coalesce((F.length("_pfx") == min(S.ROUTE_CHARS, width)) & (routing.full_key(logged, width) == F.concat("_pfx", "_key")), F.lit(False))
    found = read.join(entries, (F.col("_at") == F.col("_entry")) & own)
    # lines that aren't carried can't be made distinct before they are dealt by the hash
    hits = (found if line is None else found.repartition(logged)).select(logged.alias("_logged")).distinct()
    single = entries.groupBy("_pfx", "_key").agg(F.count("*").alias("_n"), F.max("_entry").alias("_only")).where("_n = 1")
    unreadable = lines.where(codec.line_is_bad(text)).select(F.col("offset").alias("_at"))
    retry = single.join(unreadable, F.col("_only") == F.col("_at"), "left_semi").select("_pfx", "_key")
    met = requests.join(hits, asked == F.col("_logged"), "left").select("seq", asked.alias("hash"), F.col("_logged").isNotNull().alias("_hit"))
    both = _keyed(met, width).join(retry, (F.col("pfx") == F.col("_pfx")) & (F.col("key") == F.col("_key")), "left")
    answer = F.when(F.col("_hit"), S.DUPES).when(F.col("_pfx").isNotNull(), S.RETRY).otherwise(S.PASS)
    return both.select("seq", "hash", answer.alias("status"))


def unverified(requests: DataFrame, index: DataFrame, width: int = ix.WIDTH) -> DataFrame:
    """Requests whose key is in the index, whatever the log says."""
    return _keyed(requests, width).join(index, ["pfx", "key"], "left_semi").drop("pfx", "key")


def seen(requests: DataFrame, history: DataFrame) -> DataFrame:
    return requests.join(history.select("hash"), "hash", "left_semi")


def unseen(requests: DataFrame, history: DataFrame) -> DataFrame:
    return requests.join(history.select("hash"), "hash", "left_anti")


def first_seen(offers: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each hash. Spark limits the rank in each task before the shuffle, so a frequent hash costs one row for each."""
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(order))
    return offers.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def check_then_add(offers: DataFrame, history: DataFrame, order: str = "seq") -> DataFrame:
    """What a batch adds to the history: unseen hashes, each once."""
    return first_seen(unseen(offers, history), order)


def add_status(offers: DataFrame, history: DataFrame, order: str = "seq") -> DataFrame:
    """``(seq, hash, status)`` of each offer: added for the first of an unseen hash, else dupes."""
    known = history.select(F.col("hash").alias("_known")).distinct()
    first = F.row_number().over(Window.partitionBy("hash").orderBy(order)) == 1
    joined = offers.withColumn("_first", first).join(known, F.col("hash") == F.col("_known"), "left")
    return joined.select("seq", "hash", F.when(F.col("_known").isNull() & F.col("_first"), S.ADDED).otherwise(S.DUPES).alias("status"))
