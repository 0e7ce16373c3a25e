"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.shared import stored


def _starred(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours linked to the least of them (and of the node); edges come as (u, v), u > v."""
    around = edges.select("u", "v")
    if both_ways:
        around = around.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    joined = around.join(least, "u")
    if both_ways:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b); the root is the least node of its component.

    Nodes with many neighbours are only ever grouped by a minimum and joined on, so Spark can combine and
    split them.  Each round is written to the shared folder.  No edges give no rows.
    """
    ordered = edges.filter(F.col("a") != F.col("b"))
    now = stored(ordered.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = stored(_starred(_starred(now, both_ways=True), both_ways=False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components didn't settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
