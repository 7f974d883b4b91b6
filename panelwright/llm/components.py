"""Connected components of an edge table, by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node points its larger neighbours (or its smaller ones and itself) at the least node it sees."""
    both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = both.filter("v > u") if large else both
    out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (least node of its component) for every node that an edge (columns u, v, of type long) touches.

    Self-loops alone make a component of one; repeated edges count once; nulls are ignored; no edges, no rows.
    """
    edges = edges.select("u", "v").dropna()
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    now, before = saved(edges.filter("u != v").distinct(), "edges"), None
    for _ in range(rounds):
        now = saved(_star(_star(now, large=True), large=False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
