"""Departure boards: what leaves from stops, stations or near a point, with realtime laid over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine, within_metres

_TIMES = ["realtime_departure", "realtime_arrival", "departure", "arrival"]


def in_window(start: Column | int, end: Column | int, times: list[str] = _TIMES) -> Column:
    """Any of an event's times lies in the window. [P10]"""
    inside = F.lit(False)
    for name in times:
        inside = inside | F.coalesce(F.col(name).between(start, end), F.lit(False))
    return inside


def departure_order() -> Column:
    """Realtime departure, else arrival, else the scheduled ones, else 0. [O1]"""
    return F.coalesce(*_TIMES, F.lit(0))


def board(calls: DataFrame, stops: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """Calls (with realtime columns) at any of ``stops`` in a window; ``stops`` is the small side of a semi-join. [D6, D7]"""
    return calls.join(stops.select("stop_id").distinct(), "stop_id", "left_semi").where(in_window(start, end)).withColumn("sort_time", departure_order())


def stop_group(stops: DataFrame, stop_id: object) -> DataFrame:
    """A stop with its children, and its parent's other children where name, level and platform agree. [D6, J8]"""
    own = stops.where(F.col("stop_id") == stop_id).select(F.col("stop_id").alias("__s"), F.col("parent_station").alias("__p"), F.col("name").alias("__n"), F.col("level_id").alias("__l"), F.col("platform_code").alias("__c"))
    same = (F.col("parent_station") == F.col("__p")) & F.col("name").eqNullSafe(F.col("__n")) & F.col("level_id").eqNullSafe(F.col("__l")) & F.col("platform_code").eqNullSafe(F.col("__c"))
    return stops.join(own, (F.col("stop_id") == F.col("__s")) | (F.col("parent_station") == F.col("__s")) | same, "left_semi")


def cancelled_by_alert(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """``stop_cancelled`` also where an alert of effect 1 names the stop and is in force at the event; trips are never
    cancelled by alerts. ``alerts``: effect, stop_id, start, end (null: open). [D11]"""
    off = alerts.where("effect = 1 AND stop_id IS NOT NULL").groupBy("stop_id").agg(F.collect_set(F.struct("start", "end")).alias("__periods"))
    at = F.col("__at")
    hit = F.exists("__periods", lambda p: (F.coalesce(p["start"], F.lit(0)) <= at) & (F.coalesce(p["end"], F.lit(1 << 62)) >= at))
    timed = events.withColumn("__at", F.coalesce("departure", "arrival"))  # one time to move where the two aren't asked for
    return timed.join(off, "stop_id", "left").withColumn("stop_cancelled", F.col("stop_cancelled") | F.coalesce(hit, F.lit(False))).drop("__periods", "__at")


def nearby(calls: DataFrame, stops: DataFrame, lon: float, lat: float, start: int, end: int, metres: float = 5_000, per_station: int = 10, per_headsign: int = 20) -> DataFrame:
    """Departures of the stations around a point, nearest first. [D8, W8, O2]

    ``stops``: stop_id, lon, lat, station_id (the group: merged station, else parent, else the stop). Bounded per
    station, and per headsign in a station.
    """
    near = stops.where(within_metres(F.col("lon"), F.col("lat"), lon, lat, metres)).withColumn("metres", haversine(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)))
    events = calls.join(near.select("stop_id", "station_id", "metres"), "stop_id").where(in_window(start, end)).withColumn("sort_time", departure_order())
    order = ["sort_time", "trip_id", "stop_sequence"]
    events = events.withColumn("__h", F.row_number().over(Window.partitionBy("station_id", "headsign").orderBy(*order))).where(F.col("__h") <= per_headsign)
    events = events.withColumn("__s", F.row_number().over(Window.partitionBy("station_id").orderBy(*order))).where(F.col("__s") <= per_station)
    return events.drop("__h", "__s")


def near_enough(metres: Column, kind: Column, stops: Column, stations: Column) -> Column:
    """Whether a stop counts at its distance: the more ``stops`` (and merged ``stations``) are in reach, the less far
    buses, and from 100 stations on all, may be. [P8]"""
    bus = F.when(stops > 800, 1000).when(stops > 500, 1500).when((stops > 300) & (stations <= 50), 2500).when(stations > 50, 2000).when(stops > 100, 4000)
    return ~F.coalesce((kind == 3) & (metres > bus), F.lit(False)) & ~((stations > 100) & (metres > 2500))


def block(trips: DataFrame, calls: DataFrame, block_id: object) -> DataFrame:
    """The trips of a block in order, with first and last stop and time. [D15]"""
    own = trips.where(F.col("block_id") == block_id)
    ends = calls.join(own.select("trip_id"), "trip_id", "left_semi").groupBy("trip_id").agg(
        F.min_by("stop_id", "stop_sequence").alias("first_stop"), F.max_by("stop_id", "stop_sequence").alias("last_stop"), F.min("departure").alias("starts"), F.max("arrival").alias("ends")
    )
    return own.join(ends, "trip_id").orderBy("starts", "trip_id")


def primary_route_type(types: Column) -> Column:
    """Rail, then metro, then tram, then the first listed. [D41]"""
    return F.when(F.array_contains(types, 2), 2).when(F.array_contains(types, 1), 1).when(F.array_contains(types, 0), 0).otherwise(F.get(types, F.lit(0)))
