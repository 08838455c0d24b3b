"""Range joins and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """Rows whose ``value`` lies in [``low``, ``high``]. [J11, J12]

    Ranges are replicated to the buckets of ``width`` that they touch, points have one bucket, so it is an equality join
    with a residual condition; choose the width near the usual range's.
    """
    wide = ranges.where(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return points.withColumn("__b", F.floor(F.col(value) / width).cast("long")).join(wide.hint("merge"), "__b").where(F.col(value).between(F.col(low), F.col(high))).drop("__b")


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null if it isn't one. [J11, D49]"""
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$")
    parts = F.split(ip, r"\.")
    return F.when(ok, sum((F.get(parts, F.lit(i)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0)))


def located_ips(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    """Requests (column ip) with the range that holds them, disjoint ranges of start, end addresses. [J11, D49]"""
    numbered = ranges.withColumn("__low", ip_number(F.col("ip_range_start"))).withColumn("__high", ip_number(F.col("ip_range_end")))
    return range_join(requests.withColumn("__ip", ip_number(F.col("ip"))), numbered, "__ip", "__low", "__high", 1 << 20).drop("__ip", "__low", "__high")


def fleet_of(vehicles: DataFrame, fleet: DataFrame, width: int = 1000) -> DataFrame:
    """Vehicles (chateau, label) with the fleet range of their number; labels that are no number have none. [J12, D50]"""
    numbered = vehicles.withColumn("__n", F.col("label").try_cast("int"))
    wide = fleet.withColumn("__b", F.explode(F.sequence(F.floor(F.col("starting_range") / width), F.floor(F.col("ending_range") / width))))
    found = numbered.withColumn("__b", F.floor(F.col("__n") / width)).join(wide, ["chateau", "__b"]).where("__n BETWEEN starting_range AND ending_range")
    return found.drop("__b", "__n")


def parents_and_children(stops: DataFrame) -> DataFrame:
    """Each stop with its parent, grandparent and sorted children. [J8]"""
    up = stops.select(F.col("stop_id").alias("parent_station"), F.col("parent_station").alias("grandparent"))
    down = stops.where("parent_station IS NOT NULL").groupBy(F.col("parent_station").alias("stop_id")).agg(F.sort_array(F.collect_set("stop_id")).alias("children"))
    return stops.join(up, "parent_station", "left").join(down, "stop_id", "left").select("stop_id", "parent_station", "grandparent", F.coalesce("children", F.array().cast(f"array<{dict(stops.dtypes)['stop_id']}>")).alias("children"))
