"""What the operators share: durable intermediate tables, filters of keys, rows that stay, groups of sorted rows."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new one if all run on this machine."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="msgledger-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    """Delete at exit what ``written`` left; a session that has ended already took its folder along or is not reachable."""
    for path, spark in _made.items():
        if spark.sparkContext._jsc is not None:
            _drop(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that read the table, not the plan that made it.
    Row ids that ``monotonically_increasing_id`` gave become fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the table of ``written`` that ``df`` selects from, when nothing reads it any more; other tables go when the process ends."""
    for path in {unquote(f).rpartition("/")[0] for f in df.inputFiles()}:
        name = path.rpartition("/")[2]
        for own in [p for p in _made if p.endswith(f"/{name}")]:
            _drop(_made.pop(own), own)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name


#: Bytes of an Arrow batch, which the JVM and a worker each hold several times over; a longer row is a batch of its own.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``; at its end a task gives the memory that it freed back to the machine, as its worker stays for other tasks.

    Batches are bounded in bytes: where the session hasn't set the bound itself, it is set here, for the session, as it is read when the plan runs.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- a filter of keys, of a bounded size
#: Bits of a filter: 16 or more for each key, between these bounds (8 kB and 64 MB); a fuller one passes more on, never fewer.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(keys.view(np.uint64))
    return (x & np.uint64(bits - 1)).astype(np.int64), ((x >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def key_filter(keys: DataFrame, col: str) -> np.ndarray:
    """A filter with two bits for each value of a BIGINT column, as 64-bit words.

    Its size is bounded, so it may be broadcast. It only spares work: an exact join follows it always.
    """
    keys = keys.select(F.col(col).cast("bigint").alias("key")).where("key IS NOT NULL")
    n = keys.count()
    bits = min(max(1 << (16 * n - 1).bit_length(), LEAST_BITS), MOST_BITS) if n else LEAST_BITS

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(), bits))
            yield pa.record_batch([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    got = map_arrow(keys, own, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys the filter passes: all that it was made of, and few others."""
    ok = np.ones(len(keys), bool)
    for at in _places(keys, 64 * len(words)):
        ok &= (words[at >> 6] >> (at & 63)) & 1 == 1
    return ok


# ---------------------------------------------------------------- rows that stay
def keep_rows(docs: DataFrame, key: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns, by ``decided(doc_id, key, stays)``: a row for each row of ``docs``.

    Of rows with one doc_id and key, one stays if any does; which of them, their other columns decide, so that a
    rerun keeps the same. Texts aren't shuffled but those of rows whose key may be one that a row goes for, by a filter of
    bounded size.
    """
    spark = docs.sparkSession
    cols = docs.columns
    k, null, own_id, rank = (fresh(docs, n) for n in ("key", "null", "id", "rank"))
    gone = decided.groupBy("doc_id", "key").agg(F.min("stays").alias("all"), F.max("stays").alias("any")).where("NOT all")
    gone = written(gone.select(F.col("key").alias(k), F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias(own_id), "any"), "gone")
    bits = spark.sparkContext.broadcast(key_filter(gone, k))

    @F.arrow_udf("boolean")
    def asked(keys: pa.Array) -> pa.Array:
        return pa.array(passes(bits.value, keys.to_numpy(zero_copy_only=False)))

    own = docs.withColumn(k, key)
    some = own.where(asked(F.col(k))).withColumn(null, F.col("doc_id").isNull()).withColumn(own_id, F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint"))
    # one partitioning serves the join and the window
    kept = fresh(docs, "any")
    found = some.join(gone.withColumnRenamed("any", kept), [k, null, own_id], "left").where(F.coalesce(kept, F.lit(True)))
    first = F.row_number().over(Window.partitionBy(k, null, own_id).orderBy(F.struct(*cols).cast("string")))
    stay = found.withColumn(rank, first).where(F.col(kept).isNull() | (F.col(rank) == 1))
    return own.where(~asked(F.col(k))).select(*cols).union(stay.select(*cols))


# ---------------------------------------------------------------- runs of equal keys in sorted rows
def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``keys``; the input is sorted by them. Holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def grouped_map(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, order: list[str] | None = None) -> DataFrame:
    """``fn`` over each group of rows, one group in memory at a time; callers bound the groups' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, keys):
            yield from fn(t)

    dealt = df.repartition(shuffle_parts(df.sparkSession), *keys).sortWithinPartitions(*keys, *(order or []))
    return map_arrow(dealt, run, schema)
