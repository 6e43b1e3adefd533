"""Connected components of a links table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgledger.llm.common import forget, written


def _roots(up: DataFrame) -> DataFrame:
    """``(node, up)`` with each node's topmost ``up`` in a forest; jumps double, so they are as many as the logarithm of its depth."""
    while True:
        over = up.select(F.col("node").alias("at"), F.col("up").alias("top"))
        new = written(up.join(over, up["up"] == over["at"], "left").select("node", F.col("up").alias("was"), F.coalesce("top", "up").alias("up")), "roots")
        forget(up)
        up = new.select("node", "up")
        if new.where("up <> was").limit(1).count() == 0:
            return up


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: label is the smallest node of its component.

    In each round every node goes to the smallest of its neighbours and itself (``min`` is pre-aggregated before its shuffle,
    so a hub costs one row for each task), and on to the root of the tree that this gives; roots then stand for
    their trees, and links within a tree go. So links shrink from round to round, and half of the linked nodes at least
    go in two rounds. Joins read written tables, so that adaptive execution splits the rows of a large tree.

    Self links and repeated links are allowed; null ends are dropped; no edges give no rows.
    """
    own = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = written(own.distinct(), "links")
    lab = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        up = _roots(written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("up")), "up"))
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ra")), up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        left = written(e.join(a, "a").select("b", "ra"), "half")
        rest = left.join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        rest = written(rest.distinct(), "links")
        if lab is None:
            new = up.select("node", F.col("up").alias("label"))
        else:
            top = up.select(F.col("node").alias("label"), "up")
            new = written(lab.join(top, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
            forget(lab)
            forget(up)
        forget(e)
        forget(left)
        e, lab = rest, new
        if e.limit(1).count() == 0:
            forget(e)
            return lab
