"""Station ranking: features, z-scores, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"platforms": 2.0, "stops": 1.0, "terminals": 1.5, "span": 2.0, "centrality": 1.5, "intermodal": 1.0}
RAIL_CUTS = [0.99, 0.96, 0.90, 0.75, 0.50]
OTHER_CUTS = [0.90, 0.50]


def terminal_routes(ends: DataFrame, station: str = "stop_id") -> DataFrame:
    """Distinct (chateau, route) that begin or end at a station. [A2]"""
    return ends.groupBy(station).agg(F.count_distinct("chateau", "route_id").alias("n_terminal_routes"))


def degree(neighbours: DataFrame, station: str = "stop_id", fallback: str | None = None, distinct: bool = False) -> DataFrame:
    """Distinct neighbours of a station, a neighbour without a station counting by its own id. [A4] ``distinct``: the rows
    are so already, and only counted."""
    other = F.coalesce("neighbour", F.col(fallback)) if fallback else F.col("neighbour")
    return neighbours.groupBy(station).agg((F.count if distinct else F.count_distinct)(other).alias("degree"))


def route_span(lengths: DataFrame, station: str = "stop_id", km: str = "length_km") -> DataFrame:
    """Sum over routes of ln(length + 1), long ones boosted by 1 + 1.5 ln(length / 100). [A5]"""
    boost = F.when(F.col(km) > 100, 1 + 1.5 * F.log(F.col(km) / 100)).otherwise(1.0)
    return lengths.groupBy(station).agg(F.sum(F.log(F.col(km) + 1) * boost).alias("span"))


def z_scores(stations: DataFrame, columns: list[str], within: list[str] | None = None) -> DataFrame:
    """``z_<column>``: less the mean, by the population deviation; 0 where that is below 1e-9. [A6]

    Means and deviations are one aggregate row (or one for each partition of the data), joined back, so no window
    pulls all stations to one task.
    """
    within = within or []
    stats = stations.groupBy(*within).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = stations.join(stats, within) if within else stations.crossJoin(F.broadcast(stats))  # one row
    scores = [F.when(F.col(f"__s_{c}") < 1e-9, 0.0).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias(f"z_{c}") for c in columns]
    return joined.select(*stations.columns, *scores)


def composite(terminals: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of z-scores; the span is damped to between 0.1 and 1 where fewer than 5 routes end. [A7]"""
    damp = F.when(terminals < 5, F.greatest(F.lit(0.1), terminals / 5.0)).otherwise(1.0)
    return sum((F.col(f"z_{name}") * weight * (damp if name == "span" else F.lit(1.0)) for name, weight in weights.items()), F.lit(0.0))


def tiers(stations: DataFrame, rail: str = "is_rail", score: str = "score", ident: str = "id", within: list[str] | None = None) -> DataFrame:
    """``tier`` by the share of stations at or below a score: rail 1 to 6, others 7 to 9; the id breaks ties. [W2]

    Ranks come from range-partitioned counts (see ``ranked``), not from a window over everything.
    """
    ranks = ranked(stations, [*(within or []), rail], [F.col(score), F.col(ident)])
    share = F.col("position") / F.col("total")
    rail_tier = F.lit(6)
    for i, cut in reversed(list(enumerate(RAIL_CUTS, 1))):
        rail_tier = F.when(share > cut, i).otherwise(rail_tier)
    other = F.when(share > OTHER_CUTS[0], 7).when(share > OTHER_CUTS[1], 8).otherwise(9)
    return ranks.withColumn("tier", F.when(F.col(rail), rail_tier).otherwise(other)).drop("position", "total")


def ranked(df: DataFrame, groups: list[str], order: list[Column], parts: int = 64) -> DataFrame:
    """``position`` (from 1) and ``total`` of each row in its group.

    Groups are few and may hold most rows, so rows are spread over ``parts`` ranges of the first ordering column:
    positions in a range by a window, plus the counts of the ranges before it.
    """
    from tramline.operators.components import checkpointed

    # scores and cuts are written once: their sums and sketches may differ in the last digit when they are taken again
    first, df = order[0], checkpointed(df)
    cuts = df.groupBy(*groups).agg(F.percentile_approx(first, [i / parts for i in range(1, parts)], 1000).alias("__cuts"))
    cuts = checkpointed(cuts)
    placed = df.join(cuts, groups).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < first))).drop("__cuts")
    counts = placed.groupBy(*groups, "__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("__n").over(Window.partitionBy(*groups)))
    number = F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*order))
    joined = placed.join(before, [*groups, "__part"])
    return joined.withColumn("position", F.col("__before") + number).drop("__part", "__n", "__before")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """[W8]"""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")
