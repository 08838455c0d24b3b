"""Filters, joins, aggregates, windows and set operations over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import clock, geo, text
from tramline.functions.udfs import jaro_winkler_udf
from tramline.operators import components, departures, filters, joins, ranking, realtime, search, spatial, upsert
from tramline.plans import views
from tramline.plans.registry import Tables, query
from tramline.plans.views import CALLS_SQL, STOPS_SQL, TRIPS_SQL


# --- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') AND user_id = ANY(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_list_filter(t: Tables):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return t.events.where(F.col("event_type").isin("click", "view")).join(keys, "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS kind FROM part WHERE (CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END) IS DISTINCT FROM 7")
def null_safe_filter(t: Tables):
    kinds = t.part.select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("kind"))
    return kinds.where(~F.col("kind").eqNullSafe(7))


@query("""SELECT l_orderkey AS trip_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING list_has_any(list(DISTINCT CAST(l_quantity AS INTEGER)), [0, 1, 2, 5, 12])""")
def array_overlap(t: Tables):
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.count("*").alias("n"), F.collect_set(F.col("l_quantity").cast("int")).alias("q"))
    return sets.where(F.arrays_overlap("q", F.array(*map(F.lit, (0, 1, 2, 5, 12))))).select("trip_id", "n")


@query(f"SELECT stop_id FROM ({STOPS_SQL}) WHERE lon BETWEEN -117.8 AND -117.4 AND lat BETWEEN 34.2 AND 34.6 AND sqrt(power(lon + CAST(117.6 AS DOUBLE), 2) + power(lat - CAST(34.4 AS DOUBLE), 2)) <= 0.1501")
def degree_radius(t: Tables):
    return views.stops(t).where(geo.within_degrees(F.col("lon"), F.col("lat"), -117.6, 34.4, 0.1501)).select("stop_id")


_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query(f"WITH s AS ({STOPS_SQL}), p AS (SELECT CAST(-117.6 AS DOUBLE) AS lon, CAST(34.4 AS DOUBLE) AS lat) SELECT stop_id, round({_HAV.format(a='p.', b='s.')}, 3) AS metres FROM s, p WHERE {_HAV.format(a='p.', b='s.')} <= 12345.6")
def metre_radius(t: Tables):
    lon, lat = F.col("lon"), F.col("lat")
    return views.stops(t).where(geo.within_metres(lon, lat, -117.6, 34.4, 12_345.6)).select("stop_id", F.round(geo.haversine(F.lit(-117.6), F.lit(34.4), lon, lat), 3).alias("metres"))


@query("SELECT z, CAST(CASE WHEN z <= 2 THEN 2 WHEN z <= 5 THEN 3 WHEN z <= 7 THEN 5 ELSE 10 END AS INTEGER) AS least, count(*) AS n FROM (SELECT p_size % 14 AS z, p_partkey FROM part) GROUP BY 1, 2")
def zoom_importance(t: Tables):
    z = t.part.select((F.col("p_size") % 14).alias("z"))
    return z.groupBy("z", filters.least_importance(F.col("z")).alias("least")).agg(F.count("*").alias("n"))


@query("SELECT vec_id FROM embeddings WHERE NOT (abs(embedding[1]) < 0.1 AND abs(embedding[2]) < 0.1)")
def null_island(t: Tables):
    return t.embeddings.where(geo.not_null_island(F.col("embedding")[0], F.col("embedding")[1])).select("vec_id")


@query(f"""WITH t AS ({TRIPS_SQL}), c AS ({CALLS_SQL}), s AS ({STOPS_SQL}), r AS (SELECT c_custkey AS route_id FROM customer WHERE c_nationkey % 5 = 2),
k AS (SELECT trip_id FROM t WHERE route_id IN (SELECT route_id FROM r)), u AS (SELECT * FROM s WHERE stop_id IN (SELECT stop_id FROM c WHERE trip_id IN (SELECT trip_id FROM k) AND stop_sequence = 1)),
p AS (SELECT * FROM s WHERE stop_id IN (SELECT parent_station FROM u)), g AS (SELECT * FROM s WHERE stop_id IN (SELECT parent_station FROM p))
SELECT stop_id FROM u UNION SELECT stop_id FROM p UNION SELECT stop_id FROM g""")
def route_closure(t: Tables):
    routes = t.customer.select(F.col("c_custkey").alias("route_id"), (F.col("c_nationkey") % 5).cast("int").alias("route_type"))
    feed = {"routes": routes, "trips": views.trips(t), "stop_times": views.calls(t).where("stop_sequence = 1"), "stops": views.stops(t)}
    return filters.only_route_types(feed, [2])["stops"].select("stop_id")


@query(f"SELECT trip_id, stop_sequence FROM ({CALLS_SQL}) WHERE trip_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_filter(t: Tables):
    return filters.without_orphans(views.calls(t), t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("trip_id"))).select("trip_id", "stop_sequence")


@query("""WITH x AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem GROUP BY ALL), s AS (SELECT p_partkey AS i FROM part WHERE p_size < 30)
SELECT a AS from_stop_id, b AS to_stop_id FROM x WHERE a IN (SELECT i FROM s) AND b IN (SELECT i FROM s)""")
def transfer_filter(t: Tables):
    transfers = t.lineitem.select(F.col("l_partkey").alias("from_stop_id"), F.col("l_suppkey").alias("to_stop_id")).distinct()
    return filters.valid_transfers(transfers, t.part.where("p_size < 30").select(F.col("p_partkey").alias("stop_id"))).select("from_stop_id", "to_stop_id")


@query("SELECT doc_id FROM documents WHERE NOT (contains(text, 'All rights reserved.') OR contains(text, 'Licensed under'))")
def alert_drop(t: Tables):
    alerts = t.documents.select("doc_id", F.array("text").alias("texts"))
    return filters.without_banned(alerts, "texts", ["All rights reserved.", "Licensed under"]).select("doc_id")


@query("SELECT doc_id, source, CASE WHEN lang = 'en' THEN regexp_replace(source, '^src', 'feed-') ELSE source END AS feed FROM documents")
def feed_rewrites(t: Tables):
    return filters.rewritten(t.documents.select("doc_id", "lang", "source", F.col("source").alias("feed")), [("en", "feed", "^src", "feed-")], "lang").drop("lang")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, p.a AS band, n_parts FROM lineitem JOIN (SELECT p_size AS a, p_size + 2 AS b, count(*) AS n_parts FROM part GROUP BY p_size) p ON l_quantity BETWEEN a AND b")
def range_join(t: Tables):
    bands = t.part.groupBy(F.col("p_size").alias("a")).agg(F.count("*").alias("n_parts")).withColumn("b", F.col("a") + 2)
    return joins.range_join(t.lineitem, bands, "l_quantity", "a", "b", 4).select("l_orderkey", "l_linenumber", "l_partkey", F.col("a").alias("band"), "n_parts")


@query("""SELECT e.event_id, f.k AS fleet FROM events e JOIN (SELECT s_suppkey AS k, s_suppkey * 20 AS a, s_suppkey * 20 + 9 AS b, s_suppkey % 3 AS c FROM supplier) f
ON e.event_id % 3 = f.c AND e.user_id BETWEEN f.a AND f.b WHERE e.event_id % 2 = 0""")
def fleet_join(t: Tables):
    key = F.col("s_suppkey")
    fleet = t.supplier.select(key.alias("fleet"), (key * 20).alias("starting_range"), (key * 20 + 9).alias("ending_range"), (key % 3).alias("chateau"))
    label = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("no number")
    return joins.fleet_of(t.events.select("event_id", (F.col("event_id") % 3).alias("chateau"), label.alias("label")), fleet).select("event_id", "fleet")


_NEAR_SQL = f"""a AS (SELECT stop_id, lon, lat, name, brand FROM ({STOPS_SQL})), b AS (SELECT stop_id AS osm_id, lon + CAST(0.0013 AS DOUBLE) AS lon, lat, name, brand FROM ({STOPS_SQL})),
d AS (SELECT a.stop_id, b.osm_id, a.name, b.name AS r_name, a.brand = b.brand AS same, {_HAV.format(a='a.', b='b.')} AS m FROM a JOIN b ON abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.02)"""


def _near(t: Tables):
    stops = views.stops(t)
    right = stops.select(F.col("stop_id").alias("osm_id"), F.col("name").alias("r_name"), (F.col("lon") + 0.0013).alias("r_lon"), F.col("lat").alias("r_lat"), F.col("brand").alias("r_mode"))
    return stops.select("stop_id", "name", "lon", "lat", F.col("brand").alias("mode")), right


@query(f"WITH {_NEAR_SQL} SELECT stop_id, min_by(osm_id, (m, osm_id)) AS osm_id, round(min(m), 3) AS metres FROM d WHERE m <= 1900 GROUP BY 1")
def spatial_radius_nearest(t: Tables):
    left, right = _near(t)
    return spatial.nearest_within(left, right, 1900, "stop_id", "osm_id").select("stop_id", "osm_id", F.round("metres", 3).alias("metres"))


@query(f"""WITH {_NEAR_SQL}, s AS (SELECT *, 0.3 * jaro_winkler_similarity(lower(name), lower(r_name)) + 0.7 * (1 - m / 2000) AS score FROM d WHERE m <= 2000)
SELECT stop_id, osm_id, round(score, 6) AS score FROM s WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY CASE WHEN same THEN 0 ELSE 1 END, score DESC, osm_id) = 1""")
def station_match(t: Tables):
    left, right = _near(t)
    return spatial.matched_stations(left, right, jaro_winkler_udf, metres=2000).select("stop_id", "osm_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS ({STOPS_SQL}), p AS (SELECT r_regionkey AS area_id, -118.0231 + r_regionkey * CAST(0.2 AS DOUBLE) AS x, CAST(33.9037 AS DOUBLE) AS y FROM region)
SELECT stop_id AS point_id, area_id FROM s, p WHERE lat > y AND lat < y + 0.955 AND lon > x AND lon < x + 0.335 AND (lat - y) / 0.955 + (lon - x) / 0.335 < 1""")
def point_in_polygon(t: Tables):
    x, y = F.lit(-118.0231) + F.col("r_regionkey") * F.lit(0.2), F.lit(33.9037)
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    areas = t.region.select(F.col("r_regionkey").alias("area_id"), F.array(F.array(corner(0.0, 0.0), corner(0.335, 0.0), corner(0.0, 0.955))).alias("rings"))
    return spatial.in_polygons(views.stops(t).select(F.col("stop_id").alias("point_id"), "lon", "lat"), areas)


@query(f"""WITH s AS ({STOPS_SQL}), p AS (SELECT r_regionkey AS area_id, -118.0231 + r_regionkey * CAST(0.15 AS DOUBLE) AS x, CAST(33.9037 AS DOUBLE) AS y FROM region)
SELECT stop_id AS point_id, area_id FROM s, p WHERE lat > y AND lat < y + 0.9 AND lon > x AND lon < x + 0.4 AND NOT (lat > y + 0.2 AND lat < y + 0.5 AND lon > x + 0.1 AND lon < x + 0.3)""")
def polygon_holes(t: Tables):
    x, y = F.lit(-118.0231) + F.col("r_regionkey") * F.lit(0.15), F.lit(33.9037)
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    square = lambda a, b, c, d: F.array(corner(a, b), corner(c, b), corner(c, d), corner(a, d), corner(a, b))
    areas = t.region.select(F.col("r_regionkey").alias("area_id"), F.array(square(0.0, 0.0, 0.4, 0.9), square(0.1, 0.2, 0.3, 0.5)).alias("rings"))
    return spatial.in_polygons(views.stops(t).select(F.col("stop_id").alias("point_id"), "lon", "lat"), areas, cell=0.25)


_GLOBE_SQL = "SELECT c_custkey AS id, CAST(c_custkey * 37 % 360 AS DOUBLE) - 180 + CAST(0.0007 AS DOUBLE) * (c_custkey % 11) AS lon, CAST(CASE c_custkey % 3 WHEN 0 THEN 89.2 WHEN 1 THEN 69.6 ELSE -77.8 END AS DOUBLE) + (c_custkey % 7) * CAST(0.09 AS DOUBLE) AS lat FROM customer"


@query(f"""WITH g AS ({_GLOBE_SQL}) SELECT a.id, b.id AS r_id FROM g a JOIN g b ON abs(a.lat - b.lat) < 0.6 AND {_HAV.format(a='a.', b='b.')} <= 30000""")
def radius_join_polar(t: Tables):
    """Partners near the poles and over the date line. [J15]"""
    key = F.col("c_custkey")
    lat = F.when(key % 3 == 0, 89.2).when(key % 3 == 1, 69.6).otherwise(-77.8) + key % 7 * F.lit(0.09)
    points = t.customer.select(key.alias("id"), ((key * 37 % 360).cast("double") - 180 + F.lit(0.0007) * (key % 11)).alias("lon"), lat.alias("lat"))
    return spatial.radius_join(points, points.toDF("r_id", "r_lon", "r_lat"), 30_000).select("id", "r_id")


@query(f"WITH {_NEAR_SQL} SELECT stop_id, osm_id, round(m, 3) AS metres, row_number() OVER (PARTITION BY stop_id ORDER BY m, osm_id) AS rank FROM d WHERE m <= 1900 QUALIFY rank <= 3")
def nearest_candidates(t: Tables):
    left, right = _near(t)
    return spatial.nearest_k(left, right, 1900, "stop_id", "osm_id", 3).withColumn("metres", F.round("metres", 3))


@query(f"""WITH s AS ({STOPS_SQL}) SELECT s.stop_id, s.parent_station, p.parent_station AS grandparent, coalesce((SELECT string_agg(CAST(c.stop_id AS VARCHAR), ',' ORDER BY c.stop_id) FROM s c WHERE c.parent_station = s.stop_id), '') AS children
FROM s LEFT JOIN s p ON s.parent_station = p.stop_id""")
def stop_family(t: Tables):
    return joins.parents_and_children(views.stops(t)).withColumn("children", F.array_join("children", ","))


@query("""WITH r AS (SELECT (c_custkey * 7919) % 4294967296 AS n FROM customer), g AS (SELECT s_suppkey AS city, s_suppkey * 100000 AS a, s_suppkey * 100000 + 70000 AS b FROM supplier)
SELECT n AS ip, city FROM r JOIN g ON n BETWEEN a AND b""")
def ip_location(t: Tables):
    dotted = lambda n: F.concat_ws(".", *[F.floor(n / 256**i) % 256 for i in (3, 2, 1, 0)])
    asked = t.customer.select(dotted((F.col("c_custkey") * 7919) % (1 << 32)).alias("ip"))
    key = F.col("s_suppkey") * 100_000
    last = F.lit((1 << 32) - 1)  # the highest address: ranges past it hold none, one across it ends there
    ranges = t.supplier.where(key <= last).select(F.col("s_suppkey").alias("city"), dotted(key).alias("ip_range_start"), dotted(F.least(key + 70_000, last)).alias("ip_range_end"))
    return joins.located_ips(asked, ranges).select(joins.ip_number(F.col("ip")).alias("ip"), "city")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS station, count(*) AS n_trips, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_kinds FROM orders GROUP BY 1")
def distinct_tuples(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("station")).agg(F.count("*").alias("n_trips"), F.count_distinct("o_orderstatus", "o_orderpriority").alias("n_kinds"))


@query("""WITH a AS (SELECT l_suppkey % 20 AS k, l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS routes FROM lineitem GROUP BY 1, 2) SELECT k, count(DISTINCT routes) AS n FROM a GROUP BY 1""")
def distinct_arrays(t: Tables):
    sets = t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("k"), "l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("routes"))
    return sets.groupBy("k").agg(F.count_distinct("routes").alias("n"))


@query("""SELECT l_suppkey AS stop_id, round(sum(ln(l_quantity * 10 + 1) * CASE WHEN l_quantity * 10 > 100 THEN 1 + 1.5 * ln(l_quantity * 10 / 100) ELSE 1 END), 4) AS span FROM lineitem GROUP BY 1""")
def span_log_sum(t: Tables):
    lengths = t.lineitem.select(F.col("l_suppkey").alias("stop_id"), (F.col("l_quantity") * 10).alias("length_km"))
    return ranking.route_span(lengths).select("stop_id", F.round("span", 4).alias("span"))


@query("""WITH f AS (SELECT s_suppkey AS id, s_acctbal AS a, CAST(s_nationkey AS DOUBLE) AS b, s_nationkey % 3 = 0 AS is_rail FROM supplier),
z AS (SELECT id, is_rail, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS zb FROM f), s AS (SELECT id, is_rail, round(2 * za + zb, 6) AS score FROM z),
p AS (SELECT *, row_number() OVER (PARTITION BY is_rail ORDER BY score, id) / count(*) OVER (PARTITION BY is_rail) AS share FROM s)
SELECT id, is_rail, round(score, 4) AS score, CAST(CASE WHEN is_rail THEN CASE WHEN share > 0.99 THEN 1 WHEN share > 0.96 THEN 2 WHEN share > 0.90 THEN 3 WHEN share > 0.75 THEN 4 WHEN share > 0.50 THEN 5 ELSE 6 END
  ELSE CASE WHEN share > 0.90 THEN 7 WHEN share > 0.50 THEN 8 ELSE 9 END END AS INTEGER) AS tier FROM p""")
def zscore_tiers(t: Tables):
    f = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"), (F.col("s_nationkey") % 3 == 0).alias("is_rail"))
    scored = ranking.z_scores(f, ["a", "b"]).withColumn("score", F.round(2 * F.col("z_a") + F.col("z_b"), 6))
    return ranking.tiers(scored).select("id", "is_rail", F.round("score", 4).alias("score"), "tier")


@query("SELECT p_brand AS k, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, count(*) AS n FROM part GROUP BY 1")
def set_union(t: Tables):
    return t.part.groupBy(F.col("p_brand").alias("k")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("types"), F.count("*").alias("n"))


@query(f"SELECT brand, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM ({STOPS_SQL}) GROUP BY 1")
def bbox_aggregate(t: Tables):
    return spatial.bounds(views.stops(t), ("brand",))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS u, l_suppkey - l_suppkey % 7 AS v FROM lineitem UNION SELECT p_partkey + 1000000000, p_partkey + 1000000000 + CASE WHEN p_partkey % 6 = 5 THEN 0 ELSE 1 END FROM part),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, c) AS (SELECT u, u FROM b UNION SELECT b.v, r.c FROM r JOIN b ON r.node = b.u WHERE r.c < b.v)
SELECT node, min(c) AS component FROM r GROUP BY 1""")
def connected_components(t: Tables):
    one = t.lineitem.select(F.col("l_suppkey").alias("u"), (F.col("l_suppkey") - F.col("l_suppkey") % 7).alias("v")).distinct()
    key = F.col("p_partkey") + 1_000_000_000
    two = t.part.select(key.alias("u"), (key + F.when(F.col("p_partkey") % 6 == 5, 0).otherwise(1)).alias("v"))
    return components.components(one.unionByName(two))


@query("""WITH o AS (SELECT user_id, event_type, ts, CASE WHEN event_id % 3 = 0 THEN event_id END AS trip, value FROM events)
SELECT user_id, event_type, (SELECT min_by(trip, (ts, trip)) FROM o x WHERE x.user_id = o.user_id AND x.event_type = o.event_type AND trip IS NOT NULL) AS trip, max(ts) AS ts FROM o GROUP BY 1, 2""")
def observation_merge(t: Tables):
    seen = t.events.select("user_id", "event_type", "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("trip")).withColumn("order", F.col("ts"))
    return realtime.merged_observations(seen, ["user_id", "event_type"], "order", ["trip"], "ts")


@query("SELECT c_nationkey, count(*) AS n, CAST(count(*) FILTER (c_acctbal > 0) AS BIGINT) AS n_positive, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS BIGINT) AS n_building FROM customer GROUP BY 1")
def chateau_counts(t: Tables):
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("n_positive"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("n_building"))


_TILE = "CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS y"


@query(f"SELECT {_TILE}, count(*) AS n FROM ({STOPS_SQL}) GROUP BY 1, 2")
def tile_bucket(t: Tables):
    return spatial.tile_counts(views.stops(t), 12)


@query("""WITH RECURSIVE a AS (SELECT o_custkey AS f, o_orderkey AS i, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 400 AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders),
r AS (SELECT f, n, i, s, e, CASE WHEN e < DATE '1998-01-01' - 5 THEN NULL ELSE s END AS claimed, e >= DATE '1998-01-01' - 5 AS kept FROM a WHERE n = 1
 UNION ALL SELECT a.f, a.n, a.i, a.s, CASE WHEN r.claimed IS NULL THEN a.e ELSE least(a.e, r.claimed - 1) END,
  CASE WHEN CASE WHEN r.claimed IS NULL THEN a.e ELSE least(a.e, r.claimed - 1) END < greatest(DATE '1998-01-01' - 5, a.s) THEN r.claimed ELSE a.s END,
  CASE WHEN r.claimed IS NULL THEN a.e ELSE least(a.e, r.claimed - 1) END >= greatest(DATE '1998-01-01' - 5, a.s) FROM r JOIN a ON a.f = r.f AND a.n = r.n + 1)
SELECT f AS feed_id, i AS attempt_id, s AS start_date, e AS end_date, i = max(CASE WHEN s <= DATE '1998-01-01' AND e >= DATE '1998-01-01' THEN i END) OVER (PARTITION BY f) IS TRUE AS current FROM r WHERE kept""")
def feed_claims(t: Tables):
    import datetime as dt

    from tramline.operators.claims import claimed_intervals

    day = F.to_date("o_orderdate")
    return claimed_intervals(t.orders.select(F.col("o_custkey").alias("feed_id"), F.col("o_orderkey").alias("attempt_id"), day.alias("start_date"), F.date_add(day, 400).alias("end_date")), dt.date(1998, 1, 1))


# --- windows, sorts, sets ----------------------------------------------------------------------------------------------


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 10")
def top_n_per_group(t: Tables):
    return ranking.top_per_group(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 10).select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events")
def union_distinct(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.events.select("user_id")).distinct()


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events")
def set_difference(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.events.select("user_id"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def set_intersection(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.events.select("user_id"))


@query("""WITH n AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), o AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders GROUP BY 1)
SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)""")
def keep_vanished(t: Tables):
    new = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return realtime.keep_vanished(t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v")), new, ["k"])


@query("""WITH b AS (SELECT user_id AS k, event_id AS v, ts, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS new FROM events) SELECT k, v FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY new DESC, ts DESC, v DESC) = 1""")
def upsert_latest(t: Tables):
    rows = t.events.select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "ts")
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    return upsert.upserted(rows.where(F.col("ts") < split), rows.where(F.col("ts") >= split), ["k"], ["ts", "v"]).select("k", "v")


@query("SELECT user_id AS k, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def upsert_set_union(t: Tables):
    old = t.events.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("k")).agg(F.collect_set("event_type").alias("kinds"))
    new = t.events.where("event_id % 2 = 1").groupBy(F.col("user_id").alias("k")).agg(F.collect_set("event_type").alias("kinds"))
    return upsert.upserted_sets(old, new, ["k"], "kinds").select("k", F.array_join("kinds", ",").alias("kinds"))


@query("""WITH o AS (SELECT user_id AS k, min(event_id) AS v FROM events WHERE event_type = 'click' GROUP BY 1), n AS (SELECT user_id AS k, max(event_id) AS v FROM events GROUP BY 1)
SELECT k, v FROM o UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM o)""")
def insert_ignore(t: Tables):
    old = t.events.where("event_type = 'click'").groupBy(F.col("user_id").alias("k")).agg(F.min("event_id").alias("v"))
    return upsert.inserted(old, t.events.groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("v")), ["k"])


# --- search, graph, functions --------------------------------------------------------------------------------------------


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS m FROM w),
p AS (SELECT doc_id, len(ws) AS size, unnest(ws) AS term FROM w), h AS (SELECT term, doc_id, size, count(*) AS tf FROM p WHERE term IN ('thing', 'station', 'the') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))), 4) AS score FROM h JOIN d USING (term), s GROUP BY 1""")
def search_bm25(t: Tables):
    words = search.tokens(F.col("text"))
    sizes = t.documents.agg(F.count("*").alias("n"), F.avg(F.size(words)).alias("m")).first()
    found = search.bm25(search.postings(t.documents, "doc_id", words), "doc_id", ["thing", "station", "the"], sizes.n, sizes.m or 1.0)
    return found.select("doc_id", F.round("score", 4).alias("score"))


_EDGES_SQL = f"e AS (SELECT a, b, min(c) AS c FROM (SELECT stop_id AS a, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS b, CAST(60 + stop_id % 50 AS DOUBLE) AS c FROM ({CALLS_SQL})) WHERE b IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_EDGES_SQL}, src AS (SELECT min(a) AS s FROM e), r(node, cost) AS (SELECT s, CAST(0 AS DOUBLE) FROM src UNION SELECT e.b, r.cost + e.c FROM r JOIN e ON r.node = e.a WHERE r.cost + e.c <= 300)
SELECT s AS source, node, min(cost) AS cost FROM r, src GROUP BY 1, 2""")
def walk_costs(t: Tables):
    from pyspark.sql import Window

    calls = views.calls(t)
    edges = calls.select(F.col("stop_id").alias("a"), F.lead("stop_id").over(Window.partitionBy("trip_id").orderBy("stop_sequence")).alias("b"), (60 + F.col("stop_id") % 50).cast("double").alias("cost")).where("b IS NOT NULL")
    edges = components.checkpointed(edges.groupBy("a", "b").agg(F.min("cost").alias("cost")))
    start = edges.agg(F.min("a").alias("source")).select("source", F.col("source").alias("node"))
    return components.shortest_costs(edges, start, 300)


@query("""SELECT s AS seconds, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, s AS back
FROM (SELECT DISTINCT CAST(event_id * 37 % 108000 AS INTEGER) AS s FROM events)""")
def clock_functions(t: Tables):
    rows = t.events.select((F.col("event_id") * 37 % 108_000).cast("int").alias("seconds")).distinct()
    return rows.withColumn("clock", clock.clock_of(F.col("seconds"))).withColumn("back", clock.seconds_of(F.col("clock")))


@query(f"""WITH s AS ({STOPS_SQL}), p AS (SELECT CAST(-117.5 AS DOUBLE) AS lon, CAST(34.5 AS DOUBLE) AS lat) SELECT stop_id, round({_HAV.format(a='s.', b='p.')}, 2) AS metres,
round(CASE WHEN d + 360 >= 360 THEN d ELSE d + 360 END, 6) AS bearing, round(degrees(atan2(sin(k) * cos(radians(s.lat)), cos(k) - power(sin(radians(s.lat)), 2) * cos(k))), 9) AS degree_span FROM (
SELECT s.*, p.lon AS plon, p.lat AS plat, 500 / 6371008.8 AS k, degrees(atan2(sin(radians(p.lon - s.lon)) * cos(radians(p.lat)), cos(radians(s.lat)) * sin(radians(p.lat)) - sin(radians(s.lat)) * cos(radians(p.lat)) * cos(radians(p.lon - s.lon)))) AS d FROM s, p) s,
p""")
def geo_functions(t: Tables):
    lon, lat, x, y = F.col("lon"), F.col("lat"), F.lit(-117.5), F.lit(34.5)
    return views.stops(t).select("stop_id", F.round(geo.haversine(lon, lat, x, y), 2).alias("metres"), F.round(geo.bearing(lon, lat, x, y), 6).alias("bearing"), F.round(geo.metres_to_degrees(500, lat), 9).alias("degree_span"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, list_extract(string_split(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.'), -2) AS label FROM pages""")
def url_functions(t: Tables):
    return t.pages.select("page_id", text.host_of(F.col("url")).alias("host"), text.domain_label(F.col("url")).alias("label"))


@query("SELECT event_id, props->>'k' AS k, len(json_keys(props)) AS n FROM events")
def json_map(t: Tables):
    pairs = text.translations(F.col("props"))
    return t.events.select("event_id", F.try_element_at(pairs, F.lit("k")).alias("k"), F.size(pairs).cast("long").alias("n"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', '&copy;'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(t: Tables):
    return t.pages.select("page_id", text.tags_removed(F.col("html")).alias("text"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 2 WHEN s_nationkey % 4 = 1 THEN 1 WHEN s_nationkey % 4 = 2 THEN 0 ELSE 3 END AS kind FROM supplier")
def primary_route_type(t: Tables):
    key = F.col("s_nationkey") % 4
    lists = F.when(key == 0, F.array(F.lit(3), F.lit(1), F.lit(2))).when(key == 1, F.array(F.lit(0), F.lit(1))).when(key == 2, F.array(F.lit(3), F.lit(0))).otherwise(F.array(F.lit(3), F.lit(4)))
    return t.supplier.select("s_suppkey", departures.primary_route_type(lists).alias("kind"))
