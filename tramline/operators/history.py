"""Which vehicle ran which trip: built from observations, looked up by route and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vehicle_history(observations: DataFrame, routes: DataFrame, agencies: DataFrame) -> DataFrame:
    """``observations`` (chateau, vehicle_label, trip_id, route_id, operation_date) with ``agency_id``. [D19]

    The route's agency, else the agency of the only production feed that has the route, else the chateau's only agency.
    ``routes``: chateau, route_id, feed_id, agency_id; ``agencies``: chateau, feed_id, agency_id.
    """
    key = ["chateau", "route_id"]
    own = routes.groupBy(*key).agg(F.min("agency_id").alias("__own"), F.count_distinct("feed_id").alias("__feeds"), F.min("feed_id").alias("feed_id"))
    feeds = agencies.groupBy("chateau", "feed_id").agg(F.count_distinct("agency_id").alias("__n"), F.min("agency_id").alias("__feed")).where("__n = 1").drop("__n")
    lone = agencies.groupBy("chateau").agg(F.count_distinct("agency_id").alias("__m"), F.min("agency_id").alias("__lone")).where("__m = 1").drop("__m")
    joined = observations.join(own, key, "left").join(feeds, ["chateau", "feed_id"], "left").join(lone, "chateau", "left")
    agency = F.coalesce("__own", F.when(F.col("__feeds") == 1, F.col("__feed")), "__lone")
    return joined.select(*observations.columns, agency.alias("agency_id"))


def looked_up(history: DataFrame, agencies: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of some agencies in an inclusive range of dates, newest first. [D18, O4]"""
    rows = history.where(F.col("agency_id").isin(agencies))
    rows = rows.where(F.col("operation_date") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.col("operation_date") <= F.lit(end).cast("date")) if end else rows
    return rows.orderBy(F.desc("operation_date"), "vehicle_label", "trip_id", "route_id")


def latest_vehicles(history: DataFrame) -> DataFrame:
    """The newest row of each agency's vehicles. [D19, T3]"""
    picks = [c for c in history.columns if c not in ("agency_id", "vehicle_label")]
    return history.groupBy("agency_id", "vehicle_label").agg(F.max(F.struct("operation_date", *[c for c in picks if c != "operation_date"])).alias("m")).select("agency_id", "vehicle_label", *[F.col(f"m.{c}").alias(c) for c in picks])
