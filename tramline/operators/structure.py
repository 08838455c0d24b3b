"""The shape of a network: clusters of stops, cut points, allowed turns, shared shapes, work dealt to workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.components import components, written
from tramline.operators.spatial import radius_join


def plain_name(name: Column) -> Column:
    """A name for comparison: lower case, letters and digits only. [D43, G14]"""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def names_alike(one: Column, other: Column) -> Column:
    """Equal, or one within the other, once normalised; empty names are like none. [D43]"""
    a, b = plain_name(one), plain_name(other)
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def without_derivatives(ways: DataFrame, nodes: DataFrame, metres: float = 500.0) -> DataFrame:
    """Ways (way_id, name, lon, lat) that no node of a like name (node_id, r_name, r_lon, r_lat) stands for. [D43]"""
    pairs = radius_join(ways, nodes, metres).where(names_alike(F.col("name"), F.col("r_name")))
    return ways.join(pairs.select("way_id").distinct(), "way_id", "left_anti")


def stop_clusters(stops: DataFrame, metres: float = 500.0) -> DataFrame:
    """``stop_id`` and ``cluster`` (its least stop): stops of one plain name that a chain of steps within ``metres`` joins. [G14]"""
    named = stops.withColumn("plain", plain_name(F.col("name")))
    other = named.select(F.col("stop_id").alias("r_id"), F.col("plain").alias("r_plain"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    links = radius_join(named, other, metres).where("plain = r_plain AND stop_id < r_id").select(F.col("stop_id").alias("u"), F.col("r_id").alias("v"))
    groups = components(links)
    return stops.join(groups, F.col("stop_id") == F.col("node"), "left").select("stop_id", F.coalesce("component", "stop_id").alias("cluster"))


def turn_restrictions(paths: DataFrame) -> DataFrame:
    """Turns that no path takes: node, from_edge, to_edge of edges that meet at a node but never follow each other there. [G15]

    ``paths``: path_id, seq, edge_id, from_node, to_node. A turn back onto the same edge isn't listed.
    """
    follow = Window.partitionBy("path_id").orderBy("seq")
    steps = paths.withColumn("next", F.lead("edge_id").over(follow)).withColumn("starts", F.lead("from_node").over(follow))
    taken = steps.where("next IS NOT NULL AND starts = to_node").select(F.col("to_node").alias("node"), F.col("edge_id").alias("from_edge"), F.col("next").alias("to_edge")).distinct()
    into, out = (paths.select(F.col(n).alias("node"), F.col("edge_id").alias(e)).distinct() for n, e in (("to_node", "from_edge"), ("from_node", "to_edge")))
    return into.join(out, "node").where("from_edge <> to_edge").join(taken, ["node", "from_edge", "to_edge"], "left_anti")


def cut_points(edges: list[tuple]) -> list:
    """Nodes without which a graph falls apart, by one depth-first walk without recursion. [G17]"""
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    order: dict = {}
    low: dict = {}
    found = set()
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, branches = [(root, None, iter(sorted(near[root])))], 0
        while stack:
            node, above, ahead = stack[-1]
            for other in ahead:
                if other not in order:
                    order[other] = low[other] = len(order)
                    stack.append((other, node, iter(sorted(near[other]))))
                    break
                if other != above:
                    low[node] = min(low[node], order[other])
            else:
                stack.pop()
                if above is not None:
                    low[above] = min(low[above], low[node])
                    if above != root and low[node] >= order[above]:
                        found.add(above)
                    branches += above == root
        if branches > 1:
            found.add(root)
    return sorted(found)


def articulation_points(edges: DataFrame) -> DataFrame:
    """``component`` and ``node`` of the cut points of an edge table u, v (long). [G17]

    Components are found first; each is walked in one task, so it is for line graphs, whose components are bounded by
    what a network runs side by side.
    """
    import pandas as pd

    groups = components(edges)
    tied = edges.where("u <> v").join(groups, F.col("u") == F.col("node")).select("component", "u", "v")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = cut_points(list(zip(rows["u"].tolist(), rows["v"].tolist(), strict=True)))
        return pd.DataFrame({"component": [int(rows["component"].iloc[0])] * len(nodes), "node": nodes}, columns=["component", "node"]).astype("int64")

    return tied.groupBy("component").applyInPandas(walk, "component long, node long")


def trajectories(calls: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trips between consecutive stops on shared geometry: instances (trip_id, leg, pattern_id, starts, ends) and patterns
    (pattern_id, points). [D25]

    ``calls``: trip_id, stop_sequence, lon, lat, departure, arrival, shape_id; ``lines``: shape_id, points (lon, lat). A
    leg's line is the shape between the vertices nearest to its two stops, if the second comes after the first; else,
    and without a shape, the straight line. Equal geometry is one pattern. Lines are cut once for each shape and pair of
    places, and written; their trips then meet them.
    """
    ahead = Window.partitionBy("trip_id").orderBy("stop_sequence")
    legs = calls.select("trip_id", F.col("stop_sequence").alias("leg"), "shape_id", F.col("departure").alias("starts"), F.lead("arrival").over(ahead).alias("ends"), F.struct("lon", "lat").alias("a"), F.lead(F.struct("lon", "lat")).over(ahead).alias("b")).where("b IS NOT NULL")
    nearest = lambda p: F.expr(f"array_min(transform(points, (v, i) -> named_struct('d', pow(v.lon - {p}.lon, 2) + pow(v.lat - {p}.lat, 2), 'i', i))).i")
    cut = legs.select("shape_id", "a", "b").distinct().join(lines, "shape_id", "left").withColumn("i", nearest("a")).withColumn("j", nearest("b"))
    line = F.when(F.col("j") > F.col("i"), F.expr("slice(points, i + 1, j - i + 1)")).otherwise(F.array("a", "b"))
    made = written(cut.select(F.struct("shape_id", "a", "b").alias("__way"), line.alias("points")).withColumn("pattern_id", F.sha2(F.to_json("points"), 256)))
    instances = legs.withColumn("__of", F.struct("shape_id", "a", "b")).join(made.select("__way", "pattern_id"), F.col("__of").eqNullSafe(F.col("__way")))
    return instances.select("trip_id", "leg", "pattern_id", "starts", "ends"), made.groupBy("pattern_id").agg(F.any_value("points").alias("points"))


def shards(units: DataFrame, workers: DataFrame) -> DataFrame:
    """``unit`` and ``worker``: each unit goes to the worker whose hash with it is greatest, so few move when workers come
    or go. [T15] ``units``: unit; ``workers``: worker (few rows)."""
    listed = workers.agg(F.array_sort(F.collect_set("worker")).alias("workers"))
    best = F.array_max(F.transform("workers", lambda w: F.struct(F.md5(F.concat_ws(":", w, F.col("unit"))).alias("h"), w.alias("w"))))
    return units.crossJoin(F.broadcast(listed)).select("unit", best["w"].alias("worker"))  # one row
