"""Connected components by alternating large-star and small-star steps (logarithmic rounds)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .ordering import agg_join


def _mark(edges: DataFrame):
    """Size and order-independent hash of an edge set."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each step is a minimum per node, combined before the shuffle, and a join back, so a node
    with very many neighbours is never gathered in one place. Rounds are cut by a checkpoint.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter("a <> b").distinct()
    nodes = edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()
    e = cut_lineage(e)
    mark = _mark(e)
    while True:
        # large star: larger neighbours of u hang below the smallest node around u
        sym = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = agg_join(sym, ["a"], F.least(F.min("b"), F.min("a")).alias("m"))
        large = low.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours of u, and u itself, hang below the smallest of them
        low = agg_join(large, ["a"], F.min("b").alias("m"))
        small = low.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                             F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("p"))
        e = cut_lineage(small.select("p.a", "p.b").filter("a <> b").distinct())
        new = _mark(e)
        if new == mark:
            break
        mark = new
    root = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_r"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("_r", "node").alias("component"))
