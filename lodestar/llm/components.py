"""Connected components of a graph whose edges never visit the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Edges point from the larger node u to the smaller node v, and rounds turn every component
    into a star around its smallest node. In a round each u is tied to the smallest of its v,
    m(u), and its other v are tied to m(u) in its place; then each edge (u, v) moves on to
    (u, m(v)). Both are one join of the edges with a row per node. The first round leaves
    about one edge a node, however many edges there were; a hub is one row on the side of
    m, so joins with it split well. Edges are written to the shared folder after each round.
    """
    k = 0
    found = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    found = scratch.write(found, "edges0")
    while True:
        least = found.groupBy("u").agg(F.min("v").alias("m"))
        others = found.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.write(least.select("u", F.col("m").alias("v")).unionByName(others).distinct(), f"small{k}")
        up = small.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        moved = small.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        after = scratch.write(moved.groupBy("u", "v").agg(F.max("moved").alias("moved")), f"edges{k + 1}")
        scratch.drop(f"edges{k}")
        scratch.drop(f"small{k}")
        found, k = after.select("u", "v"), k + 1
        # stars: nothing moved, so every v is a root; no u has two roots, so nothing is left to tie
        if after.where("moved").isEmpty() and found.groupBy("u").count().where("count > 1").isEmpty():
            roots = found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return found.toDF("node", "component").unionByName(roots)
