"""Operator 6: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgledger.llm.common import fresh, shuffle_parts

#: Target share of a source: its number of documents to this power, over the sum for all sources.
ALPHA = 0.5
SEED = 17
#: Sources whose rates are broadcast; with more, they are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Documents' numbers of copies are sums of Poisson draws of this mean at most, as exp of larger ones is 0.
LARGEST_MEAN = 256.0


def rates(docs: DataFrame, alpha: float = ALPHA, size: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """``(source, n, rate)``: documents of each source, and the mean number of copies of one that gives the source its target share.

    The mixture has ``size`` times as many documents as ``docs``, in the mean. ``weights(source, weight)``
    sets the target weights instead (sources that it lacks get 0); a null source is a source like others.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        own = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        w = n.join(own, F.col("source").eqNullSafe(F.col("w_source")), "left").withColumn("w", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    # sums of doubles differ with the order of rows: rounded, so that each run has the same rates
    total = w.agg(F.round(F.sum("w"), 6).alias("w_all"), F.sum("n").alias("n_all"))
    rate = F.when(F.col("w_all") > 0, F.col("w") / F.col("w_all") * F.col("n_all") * F.lit(size) / F.col("n")).otherwise(0.0)
    return w.join(F.broadcast(total)).select("source", "n", F.round(rate, 9).alias("rate"))


def uniform(key: Column, seed: int, i: Column) -> Column:
    """52 bits of a digest of seed, key and draw as a number in [0, 1)."""
    digits = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), i.cast("string"), key), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def poisson(u: Column, mean: Column) -> Column:
    """The Poisson quantile: the least k whose cumulative probability exceeds u. Terms beyond mean + 12 sqrt(mean) + 40 are under 2^-52."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    p0 = F.exp(-mean)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.lit(0).alias("k"))

    def step(acc: Column, k: Column) -> Column:
        # the sum stops where it exceeds u
        more = acc["c"] <= u
        p = acc["p"] * mean / k
        return F.when(more, F.struct(p.alias("p"), (acc["c"] + p).alias("c"), k.cast("int").alias("k"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])


def copies(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", **targets) -> DataFrame:
    """``docs`` with the columns ``mix_rate`` and ``mix_copies``: how often the mixture holds each row."""
    r = rates(docs, **targets).select(F.col("source").alias("_mix_source"), F.col("rate").alias("mix_rate"))
    if r.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        r = F.broadcast(r)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    parts = F.greatest(F.ceil(F.col("mix_rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    draws = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + poisson(uniform(key, seed, i), F.col("mix_rate") / parts))
    return docs.join(r, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source").withColumn("mix_copies", F.when(F.col("mix_rate") > 0, draws).otherwise(0))


def mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", **targets) -> DataFrame:
    """The mixture: each row of ``docs`` as often as its Poisson draw says, in a global order by a hash.

    Adds ``mix_rate``, ``mix_copies``, ``mix_copy`` (from 0) and ``mix_order`` (by which the result is range
    partitioned and sorted; equal ones by doc_id and copy). The draw depends on seed, doc_id and the source's rate
    alone, so a rerun or a lost task gives the same rows; rows with one doc_id (null ones too) get
    the same draw. A null source is a source like others; texts aren't looked at; an empty table gives no
    rows. Columns of these names in ``docs`` are replaced. Rates come of counts pre-aggregated in each task, and the order of a
    hash, so no source's share of the rows matters.
    """
    docs = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_order", "_mix_source")
    own = copies(docs, seed, id_col, **targets).where("mix_copies > 0")
    each = own.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    order = F.substring(F.sha2(F.concat_ws("|", F.lit(f"{seed}|order"), F.col("mix_copy").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256), 1, 16)
    each = each.withColumn("mix_order", order)
    # the digests are uniform: their first 32 bits deal them into ranges without a sample, so the draws are made once
    parts = shuffle_parts(docs.sparkSession)
    to = fresh(each, "range")
    each = each.withColumn(to, F.shiftright(F.conv(F.substring("mix_order", 1, 8), 16, 10).cast("bigint") * parts, 32).cast("int"))
    return each.repartitionById(parts, to).sortWithinPartitions("mix_order", id_col, "mix_copy").drop(to)
