"""Feeds, stations, alerts, vehicles and walking over the benchmark tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tramline.operators import alerts, calendar, components, filters, history, ranking, realtime, spatial, timetable
from tramline.plans import views
from tramline.plans.registry import Tables, query
from tramline.plans.timetable import _CALENDAR_SQL, _days
from tramline.plans.views import CALLS_SQL, STOPS_SQL, TRIPS_SQL
from tramline.sources import feeds, sinks

_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}lon) / 2), 2))))"
_Z = "(CASE WHEN stddev_pop({c}) OVER () < 1e-9 THEN 0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END)"


def _station_features(t: Tables):
    """Of each stop what its rank is made of: platforms (children), calls, terminal routes, span, degree, modes."""
    calls, trips, stops = views.calls(t), views.trips(t), views.stops(t)
    platforms = stops.where("parent_station IS NOT NULL").groupBy(F.col("parent_station").alias("stop_id")).agg(F.count("*").cast("double").alias("platforms"))
    n_calls = calls.groupBy("stop_id").agg(F.count("*").cast("double").alias("stops"))
    ends = timetable.terminals(calls).join(trips, "trip_id").groupBy("stop_id").agg(F.count_distinct("route_id").cast("double").alias("terminals"))
    lengths = calls.groupBy("trip_id").agg((F.max("arrival") / 10.0).alias("length_km"))
    spans = ranking.route_span(calls.select("stop_id", "trip_id").distinct().join(lengths, "trip_id"), "stop_id", "length_km")
    degree = ranking.degree(timetable.neighbours(calls), distinct=True).select("stop_id", F.col("degree").cast("double").alias("centrality"))
    modes = calls.join(trips, "trip_id").groupBy("stop_id").agg(F.count_distinct("headsign").cast("double").alias("intermodal"))
    out = stops.select("stop_id", "lon", "lat", (F.col("stop_id") % 3 == 0).alias("is_rail"))
    for part in (platforms, n_calls, ends, spans.withColumn("span", F.round("span")), degree, modes):
        out = out.join(part, "stop_id", "left")
    return out.na.fill(0.0)


_RANK_SQL = f"""stops AS ({STOPS_SQL}), calls AS ({CALLS_SQL}), trips AS ({TRIPS_SQL}),
pf AS (SELECT parent_station AS stop_id, CAST(count(*) AS DOUBLE) AS v FROM stops WHERE parent_station IS NOT NULL GROUP BY 1), cs AS (SELECT stop_id, CAST(count(*) AS DOUBLE) AS v FROM calls GROUP BY 1),
fl AS (SELECT trip_id, min(stop_sequence) AS a, max(stop_sequence) AS b, max(arrival) / 10.0 AS km FROM calls GROUP BY 1),
te AS (SELECT c.stop_id, CAST(count(DISTINCT t.route_id) AS DOUBLE) AS v FROM calls c JOIN fl ON fl.trip_id = c.trip_id AND (c.stop_sequence = a OR c.stop_sequence = b) JOIN trips t ON t.trip_id = c.trip_id GROUP BY 1),
sp AS (SELECT stop_id, round(sum(ln(km + 1) * CASE WHEN km > 100 THEN 1 + 1.5 * ln(km / 100) ELSE 1 END)) AS v FROM (SELECT DISTINCT stop_id, trip_id FROM calls) JOIN fl USING (trip_id) GROUP BY 1),
wn AS (SELECT stop_id, lag(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS p, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS n FROM calls), ed AS (SELECT stop_id, unnest([p, n]) AS o FROM wn),
dg AS (SELECT stop_id, CAST(count(DISTINCT o) AS DOUBLE) AS v FROM ed WHERE o IS NOT NULL AND o <> stop_id GROUP BY 1), im AS (SELECT stop_id, CAST(count(DISTINCT headsign) AS DOUBLE) AS v FROM calls JOIN trips USING (trip_id) GROUP BY 1),
f AS (SELECT s.stop_id, s.lon, s.lat, s.stop_id % 3 = 0 AS is_rail, coalesce(pf.v, 0) AS a, coalesce(cs.v, 0) AS b, coalesce(te.v, 0) AS c, coalesce(sp.v, 0) AS d, coalesce(dg.v, 0) AS e, coalesce(im.v, 0) AS g
  FROM stops s LEFT JOIN pf USING (stop_id) LEFT JOIN cs USING (stop_id) LEFT JOIN te USING (stop_id) LEFT JOIN sp USING (stop_id) LEFT JOIN dg USING (stop_id) LEFT JOIN im USING (stop_id)),
scored AS (SELECT stop_id, lon, lat, is_rail, round(2 * {_Z.format(c='a')} + {_Z.format(c='b')} + 1.5 * {_Z.format(c='c')} + 2 * {_Z.format(c='d')} * CASE WHEN c < 5 THEN greatest(0.1, c / 5) ELSE 1 END + 1.5 * {_Z.format(c='e')} + {_Z.format(c='g')}, 4) AS score FROM f)"""


def _scored(t: Tables):
    features = _station_features(t)
    names = list(ranking.WEIGHTS)
    columns = dict(zip(names, ["platforms", "stops", "terminals", "span", "centrality", "intermodal"], strict=True))
    renamed = features.select("stop_id", "lon", "lat", "is_rail", F.col("terminals").alias("n_terminals"), *[F.col(c).alias(n) for n, c in columns.items()])
    return ranking.z_scores(renamed, names).withColumn("score", F.round(ranking.composite(F.col("n_terminals")), 4)).select("stop_id", "lon", "lat", "is_rail", "score")


@query(f"""WITH {_RANK_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY is_rail ORDER BY score, stop_id) / count(*) OVER (PARTITION BY is_rail) AS share FROM scored)
SELECT stop_id, score, CAST(CASE WHEN is_rail THEN CASE WHEN share > 0.99 THEN 1 WHEN share > 0.96 THEN 2 WHEN share > 0.90 THEN 3 WHEN share > 0.75 THEN 4 WHEN share > 0.50 THEN 5 ELSE 6 END
  ELSE CASE WHEN share > 0.90 THEN 7 WHEN share > 0.50 THEN 8 ELSE 9 END END AS INTEGER) AS tier FROM p""")
def station_ranking(t: Tables):
    """The station ranking from counts to tiers. [D34, A7, A1, W2]"""
    return ranking.tiers(_scored(t).withColumnRenamed("stop_id", "id")).select(F.col("id").alias("stop_id"), "score", "tier")


@query("""WITH k AS (SELECT n_nationkey AS id, n_regionkey AS g, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey AS DOUBLE) AS score FROM nation)
SELECT id FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.g = a.g AND b.score > a.score)""")
def suppressed_stations(t: Tables):
    """Groups that lie within the radius of each other, far from the rest: the best of each stays. [W6]"""
    key = F.col("n_nationkey")
    points = t.nation.select(key.alias("id"), (F.col("n_regionkey") * 10 + key % 5 * F.lit(0.01)).cast("double").alias("lon"), F.lit(45.0).alias("lat"), key.cast("double").alias("score"))
    return spatial.suppressed(points, 50).select("id")


@query("SELECT s_nationkey AS k, min(s_suppkey % 20) AS west, max(s_suppkey % 20) AS east, min(s_suppkey % 13) AS south, max(s_suppkey % 13) AS north FROM supplier GROUP BY 1")
def hull_corners(t: Tables):
    """A hull has the outermost points of each side. [A16, A17]"""
    points = t.supplier.select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 20).cast("double").alias("lon"), (F.col("s_suppkey") % 13).cast("double").alias("lat"))
    corners = spatial.hulls(points, "k").select("k", F.explode("hull").alias("p"))
    return corners.groupBy("k").agg(*[f(f"p.{c}").cast("long").alias(n) for n, f, c in (("west", F.min, "lon"), ("east", F.max, "lon"), ("south", F.min, "lat"), ("north", F.max, "lat"))])


@query("""WITH a AS (SELECT event_id, user_id % 300 AS x, event_id % 40 AS p, event_id % 50 AS e FROM events) SELECT min(event_id) AS alert_id, CAST(x AS VARCHAR) AS text, count(DISTINCT p) AS n_periods, count(DISTINCT e) AS n_entities FROM (SELECT a.*, p % 10 AS comp FROM a) GROUP BY x, comp""")
def merged_alerts(t: Tables):
    """Alerts of one text that share periods or entities; as p and e agree modulo 10 only, that digit is the component. [A19]"""
    e = F.col("event_id")
    rows = t.events.select(e.alias("alert_id"), (F.col("user_id") % 300).alias("x"), (e % 40).alias("p"), (e % 50).alias("e"))
    # every period of a digit is joined to every entity of it by a bridging alert of its text
    own = rows.select("alert_id", F.col("x").cast("string").alias("text"), F.array(F.struct(F.col("p").alias("start"), (F.col("p") + 1).alias("end"))).alias("periods"), F.array(F.col("e").cast("string")).alias("entities"))
    keyed = own.withColumn("text", F.concat("text", F.lit(":"), F.get("periods", F.lit(0))["start"] % 10))
    bridged = keyed.groupBy("text").agg(F.min("alert_id").alias("alert_id"), F.array_sort(F.collect_set(F.get("periods", F.lit(0)))).alias("all_p"), F.array_sort(F.collect_set(F.get("entities", F.lit(0)))).alias("all_e"))
    chain = bridged.select(F.explode(F.flatten(F.transform("all_p", lambda p: F.transform(F.col("all_e"), lambda x: F.struct(p.alias("p"), x.alias("e")))))).alias("b"), "text", "alert_id").select((F.col("alert_id") * 1_000_000 + F.xxhash64("b") % 1_000_000 + 1_000_000_000_000).alias("alert_id"), "text", F.array("b.p").alias("periods"), F.array("b.e").alias("entities"))
    merged = components.merged_alerts(keyed.unionByName(chain))
    return merged.select("alert_id", F.substring_index("text", ":", 1).alias("text"), F.size("periods").cast("long").alias("n_periods"), F.size("entities").cast("long").alias("n_entities"))


@query(f"""WITH t AS (SELECT trip_id, 'x' || trip_id AS id, CAST(trip_id % 1000 AS VARCHAR) AS suffix, service_id FROM ({TRIPS_SQL})), r AS (SELECT suffix, min(id) AS id FROM t WHERE service_id <> '1-URGENT' GROUP BY 1),
u AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x' || event_id ELSE 'rt..' || event_id % 1200 END AS rt FROM events)
SELECT event_id, coalesce(t.id, r.id) AS trip_id FROM u LEFT JOIN t ON u.rt = t.id LEFT JOIN r ON r.suffix = regexp_extract(u.rt, '[.][.](.*)$', 1)""")
def fuzzy_trips(t: Tables):
    """[J19]"""
    key = F.col("trip_id")
    trips = views.trips(t).select(F.concat(F.lit("x"), key).alias("trip_id"), (key % 1000).cast("string").alias("suffix"), "service_id")
    e = F.col("event_id")
    seen = t.events.select("event_id", F.when(e % 2 == 0, F.concat(F.lit("x"), e)).otherwise(F.concat(F.lit("rt.."), e % 1200)).alias("rt_trip_id"))
    active = trips.select("service_id").distinct().where("service_id <> '1-URGENT'")
    return realtime.matched_trips(seen, trips, F.regexp_extract("rt_trip_id", r"\.\.(.*)$", 1), active).select("event_id", "trip_id")


@query(f"""WITH l AS (SELECT trip_id, list(DISTINCT stop_id) AS s FROM ({CALLS_SQL}) GROUP BY 1), t AS (SELECT t.trip_id, t.trip_id % 400 AS number, t.headsign, t.start_time, l.s FROM ({TRIPS_SQL}) t JOIN l USING (trip_id) WHERE service_id <> '1-URGENT'),
r AS (SELECT s_suppkey AS train, s_suppkey % 400 AS number, CASE s_suppkey % 3 WHEN 0 THEN 'o' WHEN 1 THEN 'F' ELSE 'P' END AS h, [s_suppkey % 200, s_suppkey % 77, s_suppkey % 13 + 1] AS s, 40000 AS due FROM supplier)
SELECT train AS train_id, trip_id FROM (SELECT r.train, t.trip_id, row_number() OVER (PARTITION BY r.train ORDER BY len(list_intersect(list_distinct(r.s), t.s)) DESC, CASE WHEN lower(r.h) = lower(t.headsign) THEN 0 ELSE 1 END, abs(due - start_time), t.trip_id) AS n FROM r LEFT JOIN t USING (number)) WHERE n = 1""")
def train_trips(t: Tables):
    """[D44]"""
    k = F.col("s_suppkey")
    trains = t.supplier.select(k.alias("train_id"), (k % 400).alias("number"), F.when(k % 3 == 0, "o").when(k % 3 == 1, "F").otherwise("P").alias("headsign"), F.array(k % 200, k % 77, k % 13 + 1).alias("stop_ids"), F.lit(40_000).alias("time"))
    listed = views.calls(t).groupBy("trip_id").agg(F.collect_set("stop_id").alias("stop_ids"))
    trips = views.trips(t).join(listed, "trip_id").withColumn("number", F.col("trip_id") % 400)
    return realtime.train_trips(trains, trips, trips.select("service_id").distinct().where("service_id <> '1-URGENT'")).select("train_id", "trip_id")


@query(f"""WITH c AS (SELECT trip_id, stop_id, stop_sequence - 1 AS i, arrival, departure FROM ({CALLS_SQL})), b AS (SELECT trip_id, max(departure) FILTER (i = 0) AS base FROM c GROUP BY 1)
SELECT trip_id, stop_id, arrival FROM c WHERE i < 1 UNION ALL SELECT trip_id, -1, base + 100 FROM b UNION ALL SELECT trip_id, -2, base + 250 FROM b UNION ALL SELECT trip_id, stop_id, arrival + 60 FROM c WHERE i > 2""")
def detours(t: Tables):
    """The calls from the second to the third replaced by two others, one minute's delay after. [D14]"""
    listed = views.calls(t).groupBy("trip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id", "arrival", "departure"))), lambda c: F.struct(c["stop_id"].alias("stop_id"), c["arrival"].alias("arrival"), c["departure"].alias("departure"))).alias("calls"))
    new = F.array(*[F.struct(F.lit(i).cast("long").alias("stop_id"), F.lit(s).alias("travel_time")) for i, s in ((-1, 100), (-2, 250))])
    return listed.select("trip_id", F.explode(realtime.detoured(F.col("calls"), F.lit(1), F.lit(2), new, F.lit(60))).alias("c")).select("trip_id", "c.stop_id", "c.arrival")


@query("""WITH o AS (SELECT user_id % 40 AS chateau, 'v' || event_id % 90 AS label, event_id AS trip_id, user_id AS route_id, CAST(ts AS DATE) AS d FROM events),
r AS (SELECT c_custkey % 40 AS chateau, c_custkey AS route_id, c_nationkey AS feed_id, CASE WHEN c_custkey % 3 = 0 THEN 1000 + c_custkey END AS agency_id FROM customer), a AS (SELECT s_suppkey % 40 AS chateau, s_nationkey AS feed_id, s_suppkey AS agency_id FROM supplier),
fa AS (SELECT chateau, feed_id, min(agency_id) AS agency FROM a GROUP BY 1, 2 HAVING count(DISTINCT agency_id) = 1), ca AS (SELECT chateau, min(agency_id) AS agency FROM a GROUP BY 1 HAVING count(DISTINCT agency_id) = 1),
h AS (SELECT o.*, coalesce(r.agency_id, fa.agency, ca.agency) AS agency_id FROM o LEFT JOIN r USING (chateau, route_id) LEFT JOIN fa ON fa.chateau = o.chateau AND fa.feed_id = r.feed_id LEFT JOIN ca ON ca.chateau = o.chateau)
SELECT agency_id, label AS vehicle_label, trip_id, d AS operation_date FROM h WHERE agency_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey <= 400) AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def vehicle_history(t: Tables):
    """[D18, D19, O4]"""
    seen = t.events.select((F.col("user_id") % 40).alias("chateau"), F.concat(F.lit("v"), F.col("event_id") % 90).alias("vehicle_label"), F.col("event_id").alias("trip_id"), F.col("user_id").alias("route_id"), F.to_date("ts").alias("operation_date"))
    k = F.col("c_custkey")
    routes = t.customer.select((k % 40).alias("chateau"), k.alias("route_id"), F.col("c_nationkey").alias("feed_id"), F.when(k % 3 == 0, 1000 + k).alias("agency_id"))
    agencies = t.supplier.select((F.col("s_suppkey") % 40).alias("chateau"), F.col("s_nationkey").alias("feed_id"), F.col("s_suppkey").alias("agency_id"))
    rows = history.looked_up(history.vehicle_history(seen, routes, agencies), list(range(1, 401)), "2024-01-05", "2024-01-20")
    return rows.select("agency_id", "vehicle_label", "trip_id", "operation_date")


@query("SELECT user_id % 50 AS agency_id, 'v' || user_id AS vehicle_label, max(CAST(ts AS DATE)) AS operation_date FROM events GROUP BY 1, 2")
def latest_vehicles(t: Tables):
    """[D19, T3]"""
    rows = t.events.select((F.col("user_id") % 50).alias("agency_id"), F.concat(F.lit("v"), "user_id").alias("vehicle_label"), F.to_date("ts").alias("operation_date"), F.col("event_id").alias("trip_id"))
    return history.latest_vehicles(rows).select("agency_id", "vehicle_label", "operation_date")


@query("""SELECT n_regionkey AS area_id, min_by(n_nationkey, (n_nationkey % 3 * 10 + n_nationkey % 2, n_nationkey)) AS parent_osm_id FROM nation WHERE n_nationkey % 4 <> 1 GROUP BY 1""")
def elected_parents(t: Tables):
    """[D42]"""
    k = F.col("n_nationkey")
    members = t.nation.select(F.col("n_regionkey").alias("area_id"), k.alias("osm_id"), (k % 3).alias("kind_rank"), (k % 2).alias("role_rank"), F.when(k % 4 == 1, "platform").otherwise("station").alias("station_type"))
    return feeds.elected_parents(members)


@query("SELECT event_id FROM (SELECT event_id, greatest(1000 + event_id % 500, 900 + event_id % 700) AS n FROM events) WHERE n <= 1460 AND n >= 1100")
def fresh_feeds(t: Tables):
    """[D45]"""
    return realtime.fresh(t.events.select("event_id", (1000 + F.col("event_id") % 500).alias("header_ts"), (900 + F.col("event_id") % 700).alias("entity_ts")), 1400, 300).select("event_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN 90.0 WHEN l_partkey % 11 = 0 THEN NULL ELSE round(l_quantity * 10 / (CAST(1.2 AS DOUBLE) - CASE WHEN l_linenumber = 1 THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN l_linenumber = 2 THEN CAST(0.1 AS DOUBLE) ELSE 0 END)) + CASE WHEN l_linenumber = 3 THEN 90 ELSE 0 END END AS seconds FROM lineitem""")
def foot_costs(t: Tables):
    """[G2]"""
    n = F.col("l_linenumber")
    cost = components.foot_cost(F.col("l_quantity") * 10, n == 1, n == 2, n == 3, n == 7, (F.col("l_partkey") % 11 == 0) & (n != 7), wheelchair=True)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", cost.alias("seconds"))


@query(f"WITH {_CALENDAR_SQL}, c AS (SELECT service_id, mask, start_date, end_date, coalesce((SELECT list(date) FROM exceptions e WHERE e.service_id = c.service_id AND exception_type = 1), []) AS a, coalesce((SELECT list(date) FROM exceptions e WHERE e.service_id = c.service_id AND exception_type = 2), []) AS r FROM calendar c) SELECT service_id, (list_contains(a, DATE '1996-01-20') OR (((mask >> 5) & 1) = 1 AND DATE '1996-01-20' BETWEEN start_date AND end_date)) AND NOT list_contains(r, DATE '1996-01-20') AS active FROM c")
def trip_active(t: Tables):
    """The day's bit, with what is added and taken away. [G10, D1]"""
    day = lambda n: F.date_add(F.lit("1996-01-01").cast("date"), n.cast("int"))
    key = F.col("c_custkey")
    own = t.customer.select(key.alias("service_id"), (key % 127 + 1).cast("int").alias("mask"), day(key % 30).alias("start_date"), day(key % 30 + 28).alias("end_date"))
    special = t.orders.select(F.col("o_custkey").alias("service_id"), day(F.col("o_orderkey") % 45).alias("date"), (F.col("o_orderkey") % 2 + 1).alias("kind"))
    lists = special.groupBy("service_id").agg(*[F.array_compact(F.collect_list(F.when(F.col("kind") == k, F.col("date")))).alias(n) for n, k in (("added", 1), ("removed", 2))])
    joined, none = own.join(lists, "service_id", "left"), F.array().cast("array<date>")
    return joined.select("service_id", calendar.is_active(F.lit(dt.date(1996, 1, 20)), F.col("mask"), F.col("start_date"), F.col("end_date"), F.coalesce("added", none), F.coalesce("removed", none)).alias("active"))


def _feed(t: Tables):
    routes = t.customer.select(F.col("c_custkey").alias("route_id"), F.col("c_mktsegment").alias("agency_id"))
    return {"routes": routes, "trips": views.trips(t).withColumn("service_id", F.col("route_id")), "stop_times": views.calls(t), "stops": views.stops(t)}


@query(f"WITH {_CALENDAR_SQL} SELECT trip_id FROM ({TRIPS_SQL}) WHERE route_id IN (SELECT service_id FROM days WHERE date >= DATE '1996-02-20')")
def active_after(t: Tables):
    """[P12]"""
    return filters.only_active_after(_feed(t), _days(t), "1996-02-20")["trips"].select("trip_id")


@query(f"SELECT trip_id, stop_sequence FROM ({CALLS_SQL}) WHERE trip_id IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')))")
def agencies_removed(t: Tables):
    """[P13]"""
    return filters.without_agencies(_feed(t), ["BUILDING", "MACHINERY"])["stop_times"].select("trip_id", "stop_sequence")


@query("SELECT p_partkey FROM part WHERE p_size % 9 BETWEEN 1 AND 7 AND p_partkey % 6 <> 0 AND p_partkey % 10 - 1 >= 0")
def valid_pathways(t: Tables):
    """[P16]"""
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", k.alias("from_stop_id"), F.when(k % 6 != 0, k + 1).alias("to_stop_id"), (F.col("p_size") % 9).alias("pathway_mode"), (k % 10 - 1).alias("length"), F.lit(None).cast("int").alias("traversal_time"))
    return filters.valid_pathways(rows).select("p_partkey")


@query(f"""WITH s AS ({STOPS_SQL}), m AS (SELECT stop_id, stop_id + 7 AS osm FROM s WHERE stop_id % 3 = 1), k AS (SELECT s.parent_station AS stop_id, min(m.osm) AS osm FROM s JOIN m USING (stop_id) WHERE parent_station IS NOT NULL GROUP BY 1)
SELECT s.stop_id, coalesce(m.osm, k.osm) AS osm_id FROM s LEFT JOIN m USING (stop_id) LEFT JOIN k ON s.stop_id = k.stop_id""")
def parent_matches(t: Tables):
    """[D40, K5]"""
    stops = views.stops(t)
    return spatial.with_parent_match(stops, stops.where("stop_id % 3 = 1").select("stop_id", (F.col("stop_id") + 7).alias("osm_id"))).select("stop_id", "osm_id")


@query("SELECT p_partkey FROM part WHERE NOT (p_size = 3 AND p_partkey % 50 BETWEEN 10 AND 20 AND p_partkey % 40 BETWEEN 5 AND 25)")
def tiles_dropped(t: Tables):
    """[K7]"""
    cache = t.part.select("p_partkey", F.lit("bus").alias("category"), F.col("p_size").alias("z"), (F.col("p_partkey") % 50).alias("x"), (F.col("p_partkey") % 40).alias("y"))
    return sinks.without_tiles(cache, "bus", 3, (10, 5, 20, 25)).select("p_partkey")


@query("""SELECT s_suppkey, '<trk><name>A &amp; B</name><trkseg><trkpt lat="1.5" lon="' || s_suppkey || '.0"/><trkpt lat="2.5" lon="0.0"/></trkseg></trk>' AS gpx, s_suppkey || '.0,1.5 0.0,2.5' AS kml_line, json_extract_string('{"a":"LineString"}', '$.a') AS kind, 2 AS n_points FROM supplier""")
def line_exports(t: Tables):
    """Lines as GPX, KML and GeoJSON. [K9, K11, D47, D51]"""
    k = F.col("s_suppkey").cast("double")
    line = F.array(F.struct(k.alias("lon"), F.lit(1.5).alias("lat")), F.struct(F.lit(0.0).alias("lon"), F.lit(2.5).alias("lat")))
    feature, kml = sinks.geojson_feature(line, F.struct("s_suppkey")), sinks.kml_placemark(line, F.lit("A"), F.lit("ff0000"))
    return t.supplier.select(
        "s_suppkey", sinks.gpx_track(line, F.lit("A & B")).alias("gpx"), F.regexp_extract(kml, "<coordinates>(.*)</coordinates>", 1).alias("kml_line"), F.get_json_object(feature, "$.geometry.type").alias("kind"),
        F.size(F.from_json(F.get_json_object(feature, "$.geometry.coordinates"), "array<array<double>>")).alias("n_points"),
    )


@query("""SELECT s_suppkey AS feed_id FROM supplier WHERE s_suppkey % 10 <> 3 AND (s_suppkey % 7 = 0 OR s_suppkey IN (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 10 <> 3 AND s_suppkey % 7 <> 0 GROUP BY s_suppkey % 50))""")
def feeds_without_overlaps(t: Tables):
    """[S12]"""
    k = F.col("s_suppkey")
    rows = t.supplier.select(k.alias("feed_id"), F.when(k % 7 != 0, F.concat(F.lit("u"), k % 50)).alias("url"))
    return feeds.without_overlaps(rows.where("feed_id % 10 <> 3"), []).select("feed_id")


@query("""SELECT event_id, 'Closed 07:05 & more' || event_id AS header, CASE WHEN event_id % 2 = 0 THEN 'No service at 15:00' END AS description, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 1 END AS cause, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 8 END AS effect FROM events""")
def processed_alerts(t: Tables):
    """Decoded, cleaned, clocks in 24 hours, repeated descriptions dropped, causes by keywords. [D21, D46, F14]"""
    e = F.col("event_id")
    header = F.concat(F.lit("Closed  7:05 am &amp; more"), e)
    rows = t.events.select("event_id", header.alias("header"), F.when(e % 2 == 0, "No service at 3 p.m. For more information, visit example.org").otherwise(F.concat(F.lit("Closed 7:05am &amp; more"), e)).alias("description"))
    out = alerts.processed(rows)
    cause = alerts.keyword_code(F.when(e % 3 == 0, "A strike today").otherwise("x"), alerts.CAUSES, 1)
    return out.select("event_id", "header", "description", cause.alias("cause"), alerts.keyword_code(F.coalesce("description", F.lit("")), alerts.EFFECTS, 8).alias("effect"))


@query("SELECT event_id AS alert_id, CASE WHEN k = 0 THEN user_id END AS route_id, CASE WHEN k = 1 THEN user_id + 1 END AS stop_id FROM events, (SELECT unnest([0, 1]) AS k)")
def alert_index(t: Tables):
    """[D22]"""
    entity = lambda r, s: F.struct(r.alias("route_id"), s.alias("stop_id"), F.lit(None).cast("long").alias("trip_id"))
    none, u = F.lit(None).cast("long"), F.col("user_id").cast("long")
    rows = t.events.select(F.col("event_id").alias("alert_id"), F.array(entity(u, none), entity(none, u + 1), entity(u, none)).alias("informed_entity"))
    return alerts.by_entity(rows).select("alert_id", "route_id", "stop_id")
