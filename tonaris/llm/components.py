"""Connected components by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonaris.llm.common import materialise

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a > b) are stars: each node but a centre has one edge, to its centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR up = 1 AND down = 1").count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node that has an edge to another.

    ``edges`` has columns a, b (long); direction, loops and repeats don't matter, nulls are left out. Every
    round writes its edges to the shared folder, so a lost executor costs at most one round.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(e):
            break
        last = e
        # large star: neighbours above a node go to the node's smallest neighbour
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        e = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its neighbours below go to the smallest of them
        least = e.groupBy("a").agg(F.min("b").alias("_m"))
        moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        e = materialise(moved.union(least.select("a", F.col("_m").alias("b"))).filter("a <> b").distinct(), "edges", last)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def join_components(component: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` over further edges (a, b), given the components (node, component) over those before.

    Edges are drawn between components, so the rounds don't see again what is joined already.
    """
    label = lambda end: component.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    between = edges.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    found = materialise(connected_components(between), "joined")
    moved = component.join(found.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left")
    new = found.join(component.select("node"), "node", "left_anti").select("node", "component")
    return materialise(moved.select("node", F.coalesce("_c", "component").alias("component")).union(new), "components")
