"""Connected components of links, by alternating stars: every table stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.session import Scratch


def _lowest(edges: DataFrame) -> DataFrame:
    """Per node of directed `u, v` edges, the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`node, component` of every node of the undirected edges `u, v`; a component is named by its smallest node.

    A star step links all larger neighbours of a node to its smallest neighbour, then all smaller ones; the edges end as stars
    around the smallest nodes after a number of rounds that grows with the logarithm of the longest path. The result reads a
    table in `scratch`.
    """
    edges = edges.where("u <> v")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        # The first edges are the caller's table; each round's table replaces the one before.
        edges = scratch.replace(edges, stars.where("u <> v").distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    stars = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component")).distinct()
