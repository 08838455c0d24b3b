"""Timetables: compression to patterns and back, frequencies, missing times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compress(trips: DataFrame, stop_times: DataFrame, zone: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trips as start times on shared patterns. [D3, A9, A10, W3]

    ``trips``: trip_id, route_id, service_id, direction_id, headsign, shape_id; ``stop_times``: trip_id, stop_sequence,
    stop_id, arrival, departure (seconds). Returns trips (trip_id, service_id, pattern_id, start_time), itineraries
    (pattern_id, direction_pattern_id, stop_sequence from 0, stop_id, arrival_offset, departure_offset) and directions
    (direction_pattern_id, route_id, direction_id, headsign, shape_id, stop_ids).

    Trips of fewer than two stops, or without a first or last time, are left out; a missing arrival or departure is
    the other. Rows that repeat the one before them count once. Patterns are grouped by their whole contents; ids are
    hashes of these. One shuffle gathers a trip's rows, which are few.
    """
    row = F.struct("stop_sequence", "stop_id", F.coalesce("arrival", "departure").alias("arrival"), F.coalesce("departure", "arrival").alias("departure"))
    calls = stop_times.where("stop_id IS NOT NULL").groupBy("trip_id").agg(F.sort_array(F.collect_set(row)).alias("calls"))
    joined = trips.join(calls.where(F.size("calls") >= 2), "trip_id").withColumn("start_time", F.coalesce(F.expr("calls[0].departure"), F.expr("calls[0].arrival")))
    joined = joined.where("start_time IS NOT NULL AND element_at(calls, -1).arrival IS NOT NULL")
    shape = F.transform("calls", lambda c, i: F.struct(i.alias("stop_sequence"), c["stop_id"].alias("stop_id"), (c["arrival"] - F.col("start_time")).alias("arrival_offset"), (c["departure"] - F.col("start_time")).alias("departure_offset")))
    full = joined.withColumn("rows", shape).withColumn("stop_ids", F.transform("calls", lambda c: c["stop_id"]))
    about = ["route_id", "direction_id", "headsign", "shape_id", "stop_ids"]
    full = full.withColumn("direction_pattern_id", F.sha2(F.to_json(F.struct(*about)), 256)).withColumn("pattern_id", F.sha2(F.to_json(F.struct(*about, "rows")), 256))
    itineraries = full.groupBy("pattern_id", "direction_pattern_id").agg(F.any_value("rows").alias("rows"))
    itineraries = itineraries.select("pattern_id", "direction_pattern_id", F.explode("rows").alias("r")).select("pattern_id", "direction_pattern_id", "r.*")
    directions = full.select("direction_pattern_id", *about).dropDuplicates(["direction_pattern_id"])
    return full.select("trip_id", "service_id", "pattern_id", "start_time"), itineraries, directions


def decompress(trips: DataFrame, itineraries: DataFrame, days: DataFrame) -> DataFrame:
    """Calls in absolute time: trips x their service days x their pattern's rows; ``days`` has service_id, date, midnight. [D4]"""
    calls = trips.join(days, "service_id").join(itineraries, "pattern_id")
    return calls.select("trip_id", "date", "stop_sequence", "stop_id", (F.col("midnight") + F.col("start_time") + F.col("arrival_offset")).alias("arrival"), (F.col("midnight") + F.col("start_time") + F.col("departure_offset")).alias("departure"))


def expand_frequencies(frequencies: DataFrame) -> DataFrame:
    """trip_id and each distinct start_time of [start_time, end_time) by headway_secs; headways below 1 are none. [D5]"""
    runs = frequencies.where("headway_secs > 0 AND start_time < end_time")
    of_trip = runs.groupBy("trip_id").agg(F.collect_set(F.struct("start_time", "end_time", "headway_secs")).alias("__runs"))
    starts = F.transform("__runs", lambda r: F.sequence(r["start_time"], r["end_time"] - 1, r["headway_secs"]))
    return of_trip.select("trip_id", F.explode(F.array_distinct(F.flatten(starts))).alias("start_time"))


def interpolate(stop_times: DataFrame, trip: str = "trip_id", order: str = "stop_sequence", time: str = "time", step: str = "n") -> DataFrame:
    """``time`` filled in between known ones. [W4]

    Of n missing ones between two known times a and b, the k-th gets a + k * ((b - a) div n): with ``step='n'``, as the
    feeds' users expect, the last one equals b; ``step='n+1'`` spreads them evenly. Missing ones at either end stay null.
    """
    past, ahead = Window.partitionBy(trip).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(trip).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    number = F.row_number().over(Window.partitionBy(trip).orderBy(order))
    rows = stop_times.withColumn("__n", number).withColumn("__known", F.when(F.col(time).isNotNull(), F.col("__n")))
    for name, window, pick in (("a", past, F.last), ("b", ahead, F.first)):
        rows = rows.withColumn(f"__{name}", pick(time, ignorenulls=True).over(window)).withColumn(f"__{name}n", pick("__known", ignorenulls=True).over(window))
    parts = F.col("__bn") - F.col("__an") - (1 if step == "n" else 0)
    filled = F.col("__a") + (F.col("__n") - F.col("__an")) * F.floor((F.col("__b") - F.col("__a")) / parts)
    return rows.withColumn(time, F.coalesce(F.col(time), filled.cast("int"))).drop("__n", "__known", "__a", "__an", "__b", "__bn")


def ends(stop_times: DataFrame, trip: str = "trip_id", order: str = "stop_sequence") -> DataFrame:
    """``stop_times`` with ``ordinal`` from 0 and whether a call is its trip's first or last. [W3, W5]"""
    window = Window.partitionBy(trip).orderBy(order)
    count = F.count("*").over(Window.partitionBy(trip))
    return stop_times.withColumn("ordinal", F.row_number().over(window) - 1).withColumn("is_first", F.col("ordinal") == 0).withColumn("is_last", F.col("ordinal") == count - 1)


def neighbours(stop_times: DataFrame, trip: str = "trip_id", order: str = "stop_sequence", stop: str = "stop_id") -> DataFrame:
    """``stop`` and each distinct other stop next to it on some trip. [W1, J7] Pairs are told apart without their
    direction, which halves what is hashed and moved, and turned round afterwards."""
    window = Window.partitionBy(trip).orderBy(order)
    steps = stop_times.select(F.col(stop).alias("__a"), F.lead(stop).over(window).alias("__b")).where("__a <> __b")
    pairs = steps.select(F.least("__a", "__b").alias("__a"), F.greatest("__a", "__b").alias("__b")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("__a").alias(stop), F.col("__b").alias("neighbour")), F.struct(F.col("__b").alias(stop), F.col("__a").alias("neighbour")))).alias("p")).select("p.*")


def terminals(stop_times: DataFrame, trip: str = "trip_id", order: str = "stop_sequence") -> DataFrame:
    """The rows of each trip's least and greatest sequence, by partial aggregation and a join rather than a window. [J5]"""
    span = stop_times.groupBy(trip).agg(F.min(order).alias("__least"), F.max(order).alias("__most"))
    return stop_times.join(span, trip).where((F.col(order) == F.col("__least")) | (F.col(order) == F.col("__most"))).drop("__least", "__most")
