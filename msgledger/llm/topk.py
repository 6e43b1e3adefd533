"""Operator 9: exact top-k by inner product with no-random-access aggregation of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgledger.llm.common import grouped_map, shuffle_parts, written

K, SCALE = 10, 1024
#: Candidates of a block, with a sorted list for each component; queries that one task runs against it.
BLOCK, QUERIES = 8192, 512
#: How far the lists are read, as shares of them, between two looks at the bounds; below the first no query ends.
DEPTHS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: The reading ends when so many objects at most can still qualify; their scores are then completed.
OPEN = 64


class Lists:
    """A block's vectors as one descending list of (value, object) for each component."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        n = len(x)
        order = np.argsort(-x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, order, axis=0).astype(np.float32)
        self.place = np.empty(x.shape, np.int32)  # of each object in each list
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)

    def top(self, queries: np.ndarray, k: int, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, objects (but those with the id in ``own``) and scores of its k highest inner products; ties to the smaller id.

        All lists are read in step, each from the end where the query's component makes the products
        largest; many queries share the reading. An object's score lies between what is seen of it plus the
        least products of the lists where it isn't seen yet, and the same with the products at the reading
        points. A query's reading ends when no more than OPEN objects reach its k-th best lower bound by
        their upper one; these objects' scores are then completed exactly. No other object's is.
        """
        n, dims = self.x.shape
        x = self.x.astype(np.float32)
        # bounds are sums in single precision: an allowance for their rounding
        slack = np.abs(queries) @ np.abs(x).max(axis=0) * dims * 2.0**-22 + 1
        mine = self.ids[:, None] == own
        still = np.ones((len(queries), n), bool) & ~mine.T
        active = np.flatnonzero(n - mine.sum(axis=0) > max(k, OPEN))
        up, down = (f(queries, 0).T.astype(np.float32) for f in (np.maximum, np.minimum))
        sums = np.zeros((n, len(queries)), np.float32)
        last = 0
        for depth in DEPTHS:
            at = int(n * depth)
            if not len(active) or at <= last:
                continue
            a, b = up[:, active], down[:, active]
            high_seen, low_seen = self.place < at, self.place >= n - at
            sums[:, active] += (x * (high_seen & (self.place >= last))) @ a + (x * (low_seen & (self.place < n - last))) @ b
            last = at
            hs, ls = high_seen.astype(np.float32), low_seen.astype(np.float32)

            def bound(high: np.ndarray, low: np.ndarray, a=a, b=b, hs=hs, ls=ls) -> np.ndarray:
                """What unseen entries add if each list's is ``high`` where it is read from above and ``low`` where from below."""
                p, q = a * high[:, None], b * low[:, None]
                return (p + q).sum(axis=0) - hs @ p - ls @ q

            s = sums[:, active]
            lower = (s + bound(self.values[-1], self.values[0])).T.copy()
            lower[mine.T[active]] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k]
            can = (s + bound(self.values[at - 1], self.values[n - at])).T >= (kth - 2 * slack[active])[:, None]
            still[active] &= can
            active = active[still[active].sum(axis=1) > OPEN]
        for q, open_ in zip(queries, still, strict=True):
            open_ = np.flatnonzero(open_)
            score = (self.x[open_] @ q).astype(np.int64)
            best = np.lexsort((self.ids[open_], -score))[:k]
            yield self.ids[open_][best], score[best]


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; null for a vector that is null or has a null or non-finite component."""
    d = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(d, lambda x: F.floor(x * float(scale)).cast("double")))


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    rows = lists.combine_chunks()
    n = pa.compute.list_value_length(rows).to_numpy(zero_copy_only=False)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == dims * len(n) and (n == dims).all():
        return flat.reshape(len(n), dims).astype(np.float64)
    out = np.zeros((len(n), dims))
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]) if len(n) else []] = flat
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its k highest integer inner products among ``vectors``.

    A component x counts as floor(scale * x). Candidates with the query's own id are left out. Ties go to
    the smaller vec_id, of repeated vec_ids each row is a candidate; a repeated query row has its own
    ranks, as often as it occurs, under the same id. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part; shorter vectors count as ended by zeros. Fewer than
    k candidates: all of them. Empty tables give no rows. Other columns are not read.

    Candidates are dealt by a hash into blocks of about BLOCK rows, queries into blocks of QUERIES; each
    block of queries meets each block of candidates in a task, whose results are k rows for each query.
    """
    take = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vec_col), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = take(vectors)
    asked = written(take(queries).withColumn("query", F.monotonically_increasing_id()), "queries")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    m, q_dims = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(dims or 0, q_dims or 0, 1)
    blocks, sets = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    deal = lambda of, parts: F.pmod(F.xxhash64(*of, F.lit(29)), F.lit(parts)).cast("int")
    # vectors repeated under one id are dealt by their row, too
    cand = rows.withColumn("row", F.monotonically_increasing_id()).select("id", "v", F.lit(None).cast("bigint").alias("query"), deal(["id", "row"], blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("part"))
    ask = asked.select("id", "v", "query", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(["query"], sets).alias("part"))

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        query = t["query"]
        is_query = query.is_valid()
        a, c = t.filter(is_query), t.filter(pa.compute.invert(is_query))
        if not a.num_rows or not c.num_rows:
            return
        lists = Lists(_matrix(c["v"], dims), c["id"].to_numpy())
        out = []
        own_ids = a["id"].to_numpy()
        for i, own, (ids, score) in zip(a["query"].to_pylist(), own_ids.tolist(), lists.top(_matrix(a["v"], dims), k, own_ids), strict=True):
            out.append((np.full(len(ids), i), np.full(len(ids), own), ids, score))
        yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["query", "query_id", "vec_id", "score"])

    found = grouped_map(cand.union(ask), ["block", "part"], search, "query bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
