"""Connected components of an edge table by alternating stars, entirely in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge to a smaller one; other nodes are their own component.

    ``component`` is the smallest node reachable. Loops and nulls are ignored, direction does not matter. The steps
    repeat until the edges no longer change: O(log^2 n) rounds, each written, so a lost executor costs one round at
    most. A node with very many neighbours is only ever the key of a minimum and of a join.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    current, seen = stage(pairs, "edges"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, current = state, stage(_stars(current), "edges")


def joined_components(known: DataFrame | None, edges: DataFrame, a: str, b: str) -> DataFrame:
    """The written components of all edges so far: those of ``known``, an earlier result, joined by further edges.

    Only edges between different known components are followed, so a later call works on little more than these.
    """
    if known is None:
        return stage(components(edges, a, b), "components")
    ends = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    for end in ("_a", "_b"):
        of = known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root"))
        ends = ends.join(of, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    new = components(ends.where("_a_root <> _b_root"), "_a_root", "_b_root")
    moved = new.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    kept = known.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    # A node of a new edge is the root of its old component, so it has no row yet.
    return stage(kept.union(new.select("node", "component")), "components")
