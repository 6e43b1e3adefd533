"""Where a hash lives: index prefix and key, and database and table in the six sharding modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgledger import schema as S
from msgledger.functions.codec import hex_to_int


@dataclass(frozen=True)
class Mode:
    mode: int
    dbs: int
    tables: int
    cache_pages: int
    text: str


# Databases, tables of each, cache pages of each, description.
MODES = (
    Mode(0, 1, 4096, 100000, "1 DB with 4096 tables"),
    Mode(1, 4096, 1, 500, "4096 separate DBs"),
    Mode(2, 16, 256, 2000, "16 DBs with 256 tables each"),
    Mode(3, 64, 64, 1000, "64 DBs with 64 tables each"),
    Mode(4, 128, 32, 500, "128 DBs with 32 tables each"),
    Mode(5, 512, 8, 250, "512 DBs with 8 tables each"),
)
PAGE_BYTES, MEGABYTE, MAX_OPEN = 4096, 1048576, 8


def route(hash_: Column) -> Column:
    return F.lower(F.substring(hash_, 1, S.ROUTE_CHARS))


def prefix(hash_: Column) -> Column:
    """The table's part of the key, in the hash's own case."""
    return F.substring(hash_, 1, S.ROUTE_CHARS)


def key(hash_: Column, width: int = S.KEY_CHARS) -> Column:
    return F.substring(hash_, S.ROUTE_CHARS + 1, width)


def full_key(hash_: Column, width: int = S.ROUTE_CHARS + S.KEY_CHARS) -> Column:
    return F.substring(hash_, 1, width)


def mode_of(mode: int) -> Mode:
    """Unknown modes have the sizes of mode 0."""
    return MODES[mode] if 0 <= mode < len(MODES) else MODES[0]


def _bits(n: int) -> int:
    return n.bit_length() - 1


def _value(hash_: Column, lo: int, hi: int) -> Column:
    """The hex characters lo..hi as a number; 0 if any isn't hex."""
    return F.coalesce(hex_to_int(F.substring(hash_, lo, hi - lo + 1)), F.lit(0))


def db_index(hash_: Column, mode: int) -> Column:
    """The mode's leading bits of the first 12; hashes of under 3 characters go to database 0.

    Only the hex characters that hold the bits are read: others may be anything.
    """
    bits = _bits(mode_of(mode).dbs)
    if bits == 0:
        return F.lit(0)
    chars = -(-bits // 4)
    value = F.shiftright(_value(hash_, 1, chars), 4 * chars - bits)
    return F.when(F.length(hash_) < S.ROUTE_CHARS, F.lit(0)).otherwise(value).cast("int")


def table_name(hash_: Column, mode: int) -> Column:
    """The mode's trailing bits of the first 12; hashes of under 3 characters go to ``s000`` in every mode."""
    if mode == 1:
        own = F.lit("shash")
    elif mode in (0, 2) or not 0 <= mode < len(MODES):
        own = F.concat(F.lit("s"), F.substring(hash_, 2 if mode == 2 else 1, 2 if mode == 2 else 3))
    else:
        tables = MODES[mode].tables
        bits = _bits(tables)
        chars = -(-bits // 4)
        value = _value(hash_, 4 - chars, 3).bitwiseAND(tables - 1)
        own = F.format_string("s%02x" if chars > 1 else "s%x", value)
    return F.when(F.length(hash_) < S.ROUTE_CHARS, "s000").otherwise(own)


def db_name(index: Column, dbs: int) -> Column:
    """Three hex digits; out of range ``000``."""
    return F.when((index >= 0) & (index < dbs), F.format_string("%03x", index)).otherwise("000")


def db_path(index: Column, dbs: int) -> Column:
    if dbs == 1:
        return F.lit("hashdb.sqlite3")
    return F.format_string("hashdb_%03x.sqlite3" if dbs == 4096 else "hashdb_%03d.sqlite3", index)


def hex_combinations(spark: SparkSession, n: int) -> DataFrame:
    """All strings of n hex digits in order."""
    return spark.range(16**n).select("id", F.lpad(F.lower(F.hex("id")), n, "0").alias("combination"))


def mode_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.mode, m.dbs, m.tables, m.cache_pages, m.text) for m in MODES], "mode int, dbs int, tables int, cache_pages int, text string")


def catalog(spark: SparkSession) -> DataFrame:
    """``(mode, db_index, db_name, path, table_name)`` of every table of every mode."""
    out = None
    hashes = hex_combinations(spark, S.ROUTE_CHARS)
    for m in MODES:
        c = F.col("combination")
        index = db_index(c, m.mode)
        own = hashes.select(F.lit(m.mode).alias("mode"), index.alias("db_index"), db_name(index, m.dbs).alias("db_name"), db_path(index, m.dbs).alias("path"), table_name(c, m.mode).alias("table_name"))
        out = own if out is None else out.union(own)
    return out


def memory_model(modes: DataFrame) -> DataFrame:
    """Cache, connection and total megabytes of each mode, in whole numbers as integer division gives them."""
    per_db = F.floor(F.col("cache_pages") * PAGE_BYTES / MEGABYTE).cast("bigint")
    total = per_db * F.col("dbs")
    conn = F.floor(F.col("dbs") * MAX_OPEN / 10).cast("bigint")
    return modes.select("mode", per_db.alias("mb_per_db"), total.alias("cache_mb"), conn.alias("conn_mb"), (total + conn + 5).alias("estimated_mb"))


# Fixed value: the store's option string.
OPTIONS = "?cache=shared&mode=rwc&_journal_mode=WAL&_synchronous=NORMAL&_cache_size=%d&_temp_store=memory&_mmap_size=268435456"


def connection_options(modes: DataFrame) -> DataFrame:
    return modes.select("mode", F.format_string(OPTIONS, F.col("cache_pages")).alias("options"))
