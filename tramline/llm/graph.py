"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is joins and aggregates over the edges and is written to the shared folder, so lineage stays short and
no edge reaches the driver; it only compares a count and a sum of hashes to see whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import discard, materialise

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node ``u`` (large: the greater ones, small: the lesser ones) on its least neighbour."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(turned) if large else edges
    least = materialise(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-least")
    if large:
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = materialise(moved.where("u > v").distinct(), "star")
    discard(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (least node reachable) of every node that an edge ``u``-``v`` (long) joins to another.

    Loops, repeated edges and edges with a null end are ignored; no edges give no rows. Hubs: a node's edges are
    reduced to their least end on the map side, and the table of least ends is read back from files, so adaptive
    execution can split a hub's rows in the join.
    """
    tidy = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = materialise(tidy.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        middle = _star(now, large=True)
        after = _star(middle, large=False)
        discard(now)
        discard(middle)
        now = after
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
