"""The benchmark tables seen as a timetable, for Spark and, in the same words, for the oracles.

Orders are trips, line items their calls, parts stops, customers routes, nations agencies, events realtime messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.plans.registry import Tables

TRIPS_SQL = """SELECT o_orderkey AS trip_id, o_custkey AS route_id, o_orderpriority AS service_id, CAST(o_orderdate AS DATE) AS date,
  CAST(14400 + (o_orderkey * 37) % 72000 AS INTEGER) AS start_time, o_orderstatus AS headsign, o_custkey % 50 AS block_id FROM orders"""
CALLS_SQL = """SELECT trip_id, stop_id, stop_sequence, CAST(stop_sequence * 300 + qty * 6 AS INTEGER) AS arrival, CAST(stop_sequence * 300 + qty * 6 + 30 AS INTEGER) AS departure FROM (
  SELECT l_orderkey AS trip_id, l_partkey AS stop_id, l_quantity AS qty, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS stop_sequence FROM lineitem)"""
STOPS_SQL = """SELECT p_partkey AS stop_id, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey - p_partkey % 5 END AS parent_station,
  CAST(-118 AS DOUBLE) + (p_partkey % 97) * CAST(0.01 AS DOUBLE) AS lon, CAST(34 AS DOUBLE) + (p_partkey % 89) * CAST(0.01 AS DOUBLE) AS lat, p_size AS level FROM part"""


def trips(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(key.alias("trip_id"), F.col("o_custkey").alias("route_id"), F.col("o_orderpriority").alias("service_id"), F.to_date("o_orderdate").alias("date"),
                           (14_400 + key * 37 % 72_000).cast("int").alias("start_time"), F.col("o_orderstatus").alias("headsign"), (F.col("o_custkey") % 50).alias("block_id"))


def calls(t: Tables) -> DataFrame:
    """Numbered by the trip's id under its new name: rows are then known to lie by trip, and joins by trip move them no more."""
    own = t.lineitem.select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"), F.col("l_quantity").alias("qty"), "l_linenumber", "l_suppkey", "l_extendedprice")
    window = Window.partitionBy("trip_id").orderBy("l_linenumber", "stop_id", "l_suppkey", "l_extendedprice")
    rows = own.withColumn("stop_sequence", F.row_number().over(window))
    at = F.col("stop_sequence") * 300 + F.col("qty") * 6
    return rows.select("trip_id", "stop_id", "stop_sequence", at.cast("int").alias("arrival"), (at + 30).cast("int").alias("departure"))


def stops(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select(key.alias("stop_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(key % 5 != 0, key - key % 5).alias("parent_station"),
                         (F.lit(-118.0) + key % 97 * 0.01).alias("lon"), (F.lit(34.0) + key % 89 * 0.01).alias("lat"), F.col("p_size").alias("level"))

