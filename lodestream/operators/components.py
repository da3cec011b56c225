"""Connected components by alternating star contractions, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.storage import cut, discard


def _contracted(edges: DataFrame) -> DataFrame:
    """One round: every larger neighbour of a node is linked to the least of its neighbourhood, then every smaller one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    low = up.groupBy("u").agg(F.min("v").alias("m"))
    rest = up.join(low, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rest.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge, root being the least node reached.

    Edges with a null end are ignored, and one from a node to itself makes it a node. The rounds grow with the
    logarithm of the component sizes; each is written, so that a lost executor repeats one round.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    alone = cut(ends.where("a = b").select(F.col("a").alias("node")).distinct())
    now = cut(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first()
        if mark == seen or not mark[0]:
            break
        seen, last = mark, now
        now = cut(_contracted(last))
        discard(last)
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = found.select(F.col("root").alias("node")).union(alone).join(found.select("node"), "node", "left_anti").distinct()
    return found.union(roots.select("node", F.col("node").alias("root")))
