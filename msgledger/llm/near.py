"""What near-duplicate search has in common over documents and over paragraphs: band collisions to clusters, clusters to verified links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgledger.llm.common import grouped_map, map_arrow, shuffle_parts, written
from msgledger.llm.graph import components
from msgledger.llm.shingles import linked

#: Sets that one task compares at once, and elements of all of them; larger clusters are dealt out as pairs of blocks of about this size.
BLOCK, BLOCK_ELEMENTS = 512, 4_000_000
#: Band keys that a task gathers before it joins those that collide among themselves.
CHUNK = 2_000_000


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each key its smallest node, and links from that node to the key's others."""
    at = np.lexsort((node, key))
    key, node = key[at], node[at]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    pivot = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
    other = ~first & (node != pivot)
    return key[first], node[first], pivot[other], node[other]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    u = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.record_batch([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["a", "b"])


def collisions(signed: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join all nodes sharing a band key, from ``signed(node, bands array<bigint>)``.

    Each key links its smallest node with the others, never all pairs. A task first does so among its
    own rows and passes on one node for each key, so that a key of any share of the rows costs the
    shuffle one row for each task and chunk.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat):
                keys.append(flat)
                nodes.append(np.repeat(b.column(0).to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))
                held += len(flat)
            if held >= CHUNK:
                yield _stars(np.concatenate(keys), np.concatenate(nodes))
                keys, nodes, held = [], [], 0
        if held:
            yield _stars(np.concatenate(keys), np.concatenate(nodes))

    def own_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, a, b in chunks(batches):
            yield _pairs(a, b)

    def passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, _, _ in chunks(batches):
            yield pa.record_batch([pa.array(key), pa.array(node)], names=["key", "node"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_pivot = None, 0
        for b in batches:
            key, node = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            pivots = node[np.flatnonzero(first)].copy()
            if key[0] == last_key:
                pivots[0] = last_pivot
            pivot = pivots[np.cumsum(first) - 1]
            other = node != pivot
            yield _pairs(pivot[other], node[other])
            last_key, last_pivot = key[-1], pivot[-1]

    signed = signed.select("node", "bands")
    keys = map_arrow(signed, passed_on, "key bigint, node bigint")
    keys = keys.repartition(shuffle_parts(signed.sparkSession), "key").sortWithinPartitions("key", "node")
    return map_arrow(signed, own_links, "a bigint, b bigint").union(map_arrow(keys, across, "a bigint, b bigint"))


def clusters(signed: DataFrame) -> DataFrame:
    """``(node, cluster, blocks, block)`` of nodes that collide with others; two sets that collide have one cluster. ``signed(node, bands, n)``: n is the set's size."""
    lab = components(collisions(signed))
    own = signed.groupBy("node").agg(F.max("n").alias("n"))
    # written, so that the join on clusters reads plain shuffles, of which a large cluster is split
    lab = written(lab.join(own, "node"), "sized")
    sizes = lab.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    lab = lab.join(written(sizes, "sizes"), "label")
    return lab.select("node", F.col("label").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))


def verified_links(members: DataFrame, most_bits: int, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` with den * intersection >= num * union, enough to connect all that such links connect.

    ``members(node, cluster, blocks, block, odd, shingles)``: a row for each node, with the set's hashes as bytes; odd may be null.
    A cluster of several blocks is resolved as pairs of blocks; a task holds two blocks at most, whatever the copies of a node.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("other", other).select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "odd", "shingles")

    def resolve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        node = t["node"].to_numpy()
        _, keep = np.unique(node, return_index=True)
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        block = t["block"].to_numpy()[keep]
        keep = keep[np.argsort(block, kind="stable")]
        left = int(np.count_nonzero(block == lo)) if lo != hi else None
        if len(keep) < 2:
            return
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].take(pa.array(keep)).to_pylist()]
        raw = t["odd"].take(pa.array(keep)).to_pylist()
        odd = None if raw[0] is None else np.stack([np.frombuffer(x, np.uint8) for x in raw])
        ids = node[keep]
        found = linked(sets, odd, most_bits, num, den, left)
        if found:
            a, b = np.array(found).T
            yield pa.record_batch([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return grouped_map(dealt, ["cluster", "lo", "hi"], resolve, "a bigint, b bigint")


def near_components(signed: DataFrame, sets_of, most_bits: int, num: int, den: int) -> DataFrame:
    """``(node, label)`` of the nodes linked with others; ``sets_of(cluster table)`` fetches the members' sets."""
    found = written(clusters(signed), "clusters")
    return components(verified_links(sets_of(found), most_bits, num, den))
