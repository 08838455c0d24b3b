"""The shape of the network over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import structure
from tramline.plans import views
from tramline.plans.registry import Tables, query
from tramline.plans.views import CALLS_SQL, STOPS_SQL


@query(f"""WITH s AS (SELECT stop_id, name, stop_id // 4 AS g, stop_id % 4 AS k FROM ({STOPS_SQL})) SELECT stop_id, CASE WHEN k = 3 THEN stop_id ELSE (SELECT min(stop_id) FROM s b WHERE b.g = s.g AND b.k <> 3) END AS cluster FROM s""")
def stop_clusters(t: Tables):
    """Three stops of a name 400 metres apart in a row, one of another name. [G14]"""
    k, g = F.col("stop_id") % 4, F.floor(F.col("stop_id") / 4)
    rows = views.stops(t).select("stop_id", F.when(k == 3, F.concat(F.lit("Other "), "stop_id")).otherwise(F.concat(F.lit("Place-"), g, F.when(k == 1, "!").otherwise(""))).alias("name"), (g % 300 * F.lit(0.5) - 100).alias("lon"), (F.floor(g / 300) * F.lit(0.5) + k * F.lit(0.0036)).alias("lat"))
    return structure.stop_clusters(rows)


@query("""SELECT p_partkey AS way_id FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0""")
def derived_stations(t: Tables):
    """[D43]"""
    k = F.col("p_partkey")
    x, y = k % 300 * F.lit(0.5) - 100, F.floor(k / 300) * F.lit(0.5)
    ways = t.part.select(k.alias("way_id"), F.concat(F.lit("Haupt-Bahnhof "), k).alias("name"), x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    name = F.when(k % 3 == 0, F.concat(F.lit("hauptbahnhof"), k)).when(k % 5 == 0, F.concat(F.lit("Bahnhof "), k)).otherwise("Else")
    nodes = t.part.select(k.alias("node_id"), name.alias("r_name"), x.cast("double").alias("r_lon"), (y + F.lit(0.001)).cast("double").alias("r_lat"))
    return structure.without_derivatives(ways, nodes).select("way_id")


@query(f"""WITH c AS (SELECT trip_id, stop_sequence, stop_id % 40 AS a, lead(stop_id % 40) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS b FROM ({CALLS_SQL})), p AS (SELECT *, a * 100 + b AS e FROM c WHERE b IS NOT NULL),
n AS (SELECT *, lead(e) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS nx FROM p), t AS (SELECT DISTINCT b AS node, e AS f, nx AS t FROM n WHERE nx IS NOT NULL), i AS (SELECT DISTINCT b AS node, e AS f FROM p), o AS (SELECT DISTINCT a AS node, e AS t FROM p)
SELECT node, i.f AS from_edge, o.t AS to_edge FROM i JOIN o USING (node) WHERE i.f <> o.t AND NOT EXISTS (SELECT 1 FROM t WHERE t.node = i.node AND t.f = i.f AND t.t = o.t)""")
def turn_restrictions(t: Tables):
    """[G15]"""
    from pyspark.sql import Window

    ahead = F.lead(F.col("stop_id") % 40).over(Window.partitionBy("trip_id").orderBy("stop_sequence"))
    steps = views.calls(t).select(F.col("trip_id").alias("path_id"), F.col("stop_sequence").alias("seq"), (F.col("stop_id") % 40).alias("from_node"), ahead.alias("to_node")).where("to_node IS NOT NULL")
    return structure.turn_restrictions(steps.withColumn("edge_id", F.col("from_node") * 100 + F.col("to_node")))


@query("""WITH e AS (SELECT p_partkey AS u, p_partkey - p_partkey % 7 AS v FROM part WHERE p_partkey % 7 BETWEEN 1 AND 4 UNION SELECT p_partkey, p_partkey - 1 FROM part WHERE p_partkey % 7 IN (4, 5, 6)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e) SELECT min(a.v) FILTER (true) AS least, x AS node FROM (SELECT DISTINCT u AS x, u - u % 7 AS k FROM b) n JOIN b a ON a.u - a.u % 7 = k
WHERE (x % 7 = 0 AND EXISTS (SELECT 1 FROM b c WHERE c.u = x AND c.v % 7 = 1) AND EXISTS (SELECT 1 FROM b c WHERE c.u = x AND c.v % 7 = 2)) OR (x % 7 IN (4, 5) AND EXISTS (SELECT 1 FROM b c WHERE c.u = x AND c.v = x + 1)) GROUP BY x""")
def articulation_points(t: Tables):
    """Seven parts: two leaves and a ring on the first, a tail on the ring. [G17]"""
    k = F.col("p_partkey")
    one = t.part.where("p_partkey % 7 BETWEEN 1 AND 4").select(k.alias("u"), (k - k % 7).alias("v"))
    two = t.part.where("p_partkey % 7 IN (4, 5, 6)").select(k.alias("u"), (k - 1).alias("v"))
    return structure.articulation_points(one.unionByName(two)).select(F.col("component").alias("least"), "node")


@query(f"""WITH c AS (SELECT trip_id, stop_sequence, trip_id % 3 AS s, lead(stop_sequence) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS nx, departure, lead(arrival) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS ends FROM ({CALLS_SQL}))
SELECT trip_id, stop_sequence AS leg, departure AS starts, ends, CAST(CASE WHEN s = 0 THEN 2 ELSE 3 END AS INTEGER) AS n_points FROM c WHERE nx IS NOT NULL""")
def trajectories(t: Tables):
    """Stops on every second vertex of a shape; a third of the trips has none. [D25, D38]"""
    calls = views.calls(t).select("trip_id", "stop_sequence", (F.col("stop_sequence") * F.lit(0.2)).alias("lon"), F.lit(1.0).alias("lat"), "departure", "arrival", F.when(F.col("trip_id") % 3 != 0, F.col("trip_id") % 3).alias("shape_id"))
    points = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.struct((i * F.lit(0.1)).alias("lon"), F.lit(1.0).alias("lat")))
    lines = t.region.where("r_regionkey IN (1, 2)").select(F.col("r_regionkey").alias("shape_id"), points.alias("points"))
    legs, patterns = structure.trajectories(calls, lines)
    return legs.join(patterns, "pattern_id").select("trip_id", "leg", "starts", "ends", F.size("points").alias("n_points"))


@query("""WITH w AS (SELECT n_nationkey AS worker FROM nation), x AS (SELECT c_custkey AS unit, worker, md5(worker || ':' || c_custkey) AS h FROM customer, w) SELECT unit, max_by(worker, (h, worker)) AS worker FROM x GROUP BY 1""")
def shard_assignment(t: Tables):
    """[T15]"""
    return structure.shards(t.customer.select(F.col("c_custkey").alias("unit")), t.nation.select(F.col("n_nationkey").alias("worker")))
