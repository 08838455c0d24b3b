"""What applications read, over the benchmark tables: trips, routes, boards, vehicles, viewports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions.clock import wall_seconds
from tramline.operators import reads, realtime
from tramline.plans import views
from tramline.plans.registry import Tables, query
from tramline.plans.timetable import _BOARD_SQL, _FROM, _LAID, _TO, _scheduled, _updates
from tramline.plans.views import CALLS_SQL, STOPS_SQL, TRIPS_SQL

_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query(f"""WITH trips AS ({TRIPS_SQL}), calls AS ({CALLS_SQL}), stops AS ({STOPS_SQL}),
days AS (SELECT DISTINCT route_id AS service_id, date + 3 AS date FROM trips),
asked AS (SELECT trip_id, route_id, date AS observed, start_time FROM trips),
dated AS (SELECT a.trip_id, a.route_id, a.start_time, d.date FROM asked a JOIN days d ON d.service_id = a.route_id AND d.date BETWEEN a.observed - 10 AND a.observed + 9
  QUALIFY row_number() OVER (PARTITION BY a.trip_id ORDER BY abs(d.date - a.observed), d.date) = 1),
upd AS (SELECT c.trip_id, d.date, c.stop_sequence, CAST(epoch(CAST(d.date AS TIMESTAMP)) AS BIGINT) + start_time + departure + c.trip_id % 600 AS rt, c.trip_id % 97 = 0 AS off FROM calls c JOIN dated d ON c.trip_id = d.trip_id WHERE c.trip_id % 3 = 0),
al AS (SELECT event_id AS alert_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS route_id, CASE WHEN event_id % 3 = 1 THEN user_id END AS stop_id, CASE WHEN event_id % 3 = 2 THEN event_id END AS trip_id FROM events),
ar AS (SELECT route_id, list(DISTINCT alert_id) AS l FROM al WHERE route_id IS NOT NULL GROUP BY 1), st AS (SELECT stop_id, list(DISTINCT alert_id) AS l FROM al WHERE stop_id IS NOT NULL GROUP BY 1), tr AS (SELECT trip_id, list(DISTINCT alert_id) AS l FROM al WHERE trip_id IS NOT NULL GROUP BY 1)
SELECT c.trip_id, d.date, c.stop_sequence, s.name AS stop_name, CAST(epoch(CAST(d.date AS TIMESTAMP)) AS BIGINT) + d.start_time + c.departure AS departure, u.rt AS realtime_departure, coalesce(u.off, false) AS trip_cancelled,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(ar.l, []), coalesce(st.l, []), coalesce(tr.l, [])))), ',') AS alert_ids
FROM dated d JOIN calls c ON c.trip_id = d.trip_id LEFT JOIN upd u ON u.trip_id = c.trip_id AND u.stop_sequence = c.stop_sequence LEFT JOIN stops s ON s.stop_id = c.stop_id
LEFT JOIN ar ON ar.route_id = d.route_id LEFT JOIN st ON st.stop_id = c.stop_id LEFT JOIN tr ON tr.trip_id = c.trip_id""")
def trip_details(t: Tables):
    """[D13]"""
    trips = views.trips(t).withColumn("service_id", F.col("route_id"))
    days = trips.select("service_id", F.date_add("date", 3).alias("date")).distinct().withColumn("midnight", wall_seconds(F.col("date").cast("timestamp_ntz")))
    asked = trips.select("trip_id", F.col("date").alias("observed"))
    own = trips.select("trip_id", "route_id", "service_id", "start_time")
    dated = realtime.nearest_service_date(asked.join(own, "trip_id"), days).where("trip_id % 3 = 0")  # which trips have updates
    at = F.col("midnight") + F.col("start_time") + F.col("departure") + F.col("trip_id") % 600
    updates = views.calls(t).join(dated.select("trip_id", "date", "midnight", "start_time"), "trip_id").select(
        "trip_id", "date", F.lit(None).cast("long").alias("stop_id"), "stop_sequence", F.when(F.col("trip_id") % 97 == 0, "CANCELED").otherwise("SCHEDULED").alias("trip_status"), F.lit(None).cast("string").alias("stop_status"),
        at.alias("rt_departure"), F.lit(None).cast("long").alias("rt_arrival"), F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("vehicle"),
    )
    kind = F.col("event_id") % 3
    alerts = t.events.select(F.col("event_id").alias("alert_id"), F.when(kind == 0, F.col("user_id")).alias("route_id"), F.when(kind == 1, F.col("user_id")).alias("stop_id"), F.when(kind == 2, F.col("event_id")).alias("trip_id"))
    out = reads.trip_details(asked, own, views.calls(t), views.stops(t), days, updates, alerts)
    return out.select("trip_id", "date", "stop_sequence", "stop_name", "departure", "realtime_departure", "trip_cancelled", F.array_join("alert_ids", ",").alias("alert_ids"))


@query(f"""WITH trips AS ({TRIPS_SQL}), calls AS ({CALLS_SQL}), stops AS ({STOPS_SQL}), routes AS (SELECT c_custkey AS route_id, n_name AS agency_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
pat AS (SELECT DISTINCT t.route_id, t.headsign, l.k FROM trips t JOIN (SELECT trip_id, string_agg(CAST(stop_id AS VARCHAR), '>' ORDER BY stop_sequence) AS k FROM calls GROUP BY 1) l ON t.trip_id = l.trip_id),
np AS (SELECT route_id, count(*) AS n_patterns FROM pat GROUP BY 1), cal AS (SELECT DISTINCT t.route_id, c.stop_id FROM trips t JOIN calls c ON t.trip_id = c.trip_id),
pl AS (SELECT route_id, count(*) AS n_stops, min(lon) AS west, max(lat) AS north FROM cal JOIN stops USING (stop_id) GROUP BY 1), cx AS (SELECT a.route_id, count(DISTINCT b.route_id) AS n FROM cal a JOIN cal b ON a.stop_id = b.stop_id AND a.route_id <> b.route_id GROUP BY 1),
al AS (SELECT user_id AS route_id, count(DISTINCT event_id) AS n_alerts FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT r.route_id, agency_name, n_patterns, n_stops, west, north, coalesce(cx.n, 0) AS n_connecting, n_alerts FROM routes r LEFT JOIN np USING (route_id) LEFT JOIN pl USING (route_id) LEFT JOIN cx USING (route_id) LEFT JOIN al USING (route_id)""")
def route_info(t: Tables):
    """[D16]"""
    routes = t.customer.select(F.col("c_custkey").alias("route_id"), F.col("c_nationkey").alias("agency_id"))
    agencies = t.nation.select(F.col("n_nationkey").alias("agency_id"), F.col("n_name").alias("agency_name"))
    alerts = t.events.where("event_type = 'click'").select(F.col("user_id").alias("route_id"), F.col("event_id").alias("alert_id"))
    out = reads.route_info(routes, agencies, views.trips(t), views.calls(t), views.stops(t), alerts)
    sized = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return out.select("route_id", "agency_name", sized("directions").alias("n_patterns"), "n_stops", "west", "north", "n_connecting", sized("alert_ids").alias("n_alerts"))


@query(f"""WITH {_BOARD_SQL}, asked AS (SELECT r_regionkey AS ask_id, -118 + r_regionkey * CAST(0.2 AS DOUBLE) AS lon, 34 + r_regionkey * CAST(0.2 AS DOUBLE) AS lat FROM region),
near AS (SELECT ask_id, stop_id, CASE WHEN stop_id % 4 = 0 THEN 'o' || stop_id // 8 WHEN parent_station IS NOT NULL THEN 'p' || parent_station ELSE 's' || stop_id END AS station, stop_id % 4 AS route_type, {_HAV.format(a='a.', b='s.')} AS m FROM asked a JOIN stops s ON abs(a.lat - s.lat) < 0.1 WHERE m <= 5000),
st AS (SELECT ask_id, station, min(m) AS sm, (dense_rank() OVER (PARTITION BY ask_id ORDER BY min(m), station) - 1) // 5 AS chunk FROM near GROUP BY 1, 2),
ev AS (SELECT l.*, n.ask_id, n.station, n.route_type, coalesce(realtime_departure, realtime_arrival, departure, arrival, 0) AS sort_time FROM laid l JOIN near n ON l.stop_id = n.stop_id
  WHERE coalesce(realtime_departure BETWEEN {_FROM} AND {_TO}, false) OR coalesce(realtime_arrival BETWEEN {_FROM} AND {_TO}, false) OR departure BETWEEN {_FROM} AND {_TO} OR arrival BETWEEN {_FROM} AND {_TO}),
h AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY ask_id, station, headsign ORDER BY sort_time, trip_id, stop_sequence) <= 20)
SELECT ask_id, station, trip_id, stop_sequence, sort_time, CAST(chunk AS BIGINT) AS chunk, route_type = 2 AS long_distance FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY ask_id, station ORDER BY sort_time, trip_id, stop_sequence) <= 10) JOIN st USING (ask_id, station)""")
def nearby_departures(t: Tables):
    """[D8, D9]"""
    asked = t.region.select(F.col("r_regionkey").alias("ask_id"), (F.lit(-118) + F.col("r_regionkey") * F.lit(0.2)).alias("lon"), (F.lit(34) + F.col("r_regionkey") * F.lit(0.2)).alias("lat"))
    key = F.col("stop_id")
    stops = views.stops(t).select("stop_id", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), F.when(key % 4 == 0, F.floor(key / 8)).alias("osm_id"), "parent_station", (key % 4).alias("route_type"))
    scheduled = _scheduled(t)
    board = reads.nearby_board(asked, realtime.overlay(scheduled, _updates(scheduled)).select(*_LAID, "headsign"), stops, _FROM, _TO)
    return board.select("ask_id", "station", "trip_id", "stop_sequence", "sort_time", "chunk", "long_distance")


@query(f"""WITH s AS ({STOPS_SQL}), base AS (SELECT stop_id, lon, lat, stop_id % 4 AS k FROM s WHERE level < 20), o AS (SELECT stop_id AS other_id, lon + CAST(0.0009 AS DOUBLE) * (stop_id % 5) AS lon, lat, stop_id % 5 AS k FROM s),
p AS (SELECT other_id, stop_id, o.k AS ok, base.k AS bk, {_HAV.format(a='base.', b='o.')} AS m FROM base JOIN o ON abs(base.lat - o.lat) < 0.01 AND abs(base.lon - o.lon) < 0.01)
SELECT other_id, stop_id, round(m, 3) AS metres FROM p WHERE m <= CASE WHEN bk IN (0, 1) THEN CASE ok WHEN 3 THEN 150 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 400 ELSE 300 END
  WHEN bk = 2 THEN CASE ok WHEN 3 THEN 200 ELSE 300 END ELSE CASE ok WHEN 3 THEN 150 WHEN 0 THEN 200 WHEN 1 THEN 200 ELSE 300 END END
QUALIFY row_number() OVER (PARTITION BY other_id ORDER BY m, stop_id <> other_id, stop_id) = 1""")
def connecting_stops(t: Tables):
    """[D17, J15]"""
    stops = views.stops(t)
    base = stops.where("level < 20").select("stop_id", "lon", "lat", (F.col("stop_id") % 4).alias("route_type"))
    others = stops.select(F.col("stop_id").alias("other_id"), (F.col("lon") + F.lit(0.0009) * (F.col("stop_id") % 5)).alias("r_lon"), F.col("lat").alias("r_lat"), (F.col("stop_id") % 5).alias("r_type"))
    return reads.connections(base, others).withColumn("metres", F.round("metres", 3))


_POS_SQL = "pos AS (SELECT event_id AS vehicle_id, 'v' || user_id AS vehicle_label, event_id % 7 AS chateau, user_id % 4 AS route_type, user_id % 900 AS route_id, event_id % 5000 AS trip_id, CAST(-118 AS DOUBLE) + (event_id % 97) * CAST(0.01 AS DOUBLE) AS lon, CAST(34 AS DOUBLE) + (event_id % 89) * CAST(0.01 AS DOUBLE) AS lat, event_id AS timestamp FROM events)"


def _positions(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    return t.events.select(e.alias("vehicle_id"), F.concat(F.lit("v"), u).alias("vehicle_label"), (e % 7).alias("chateau"), (u % 4).alias("route_type"), (u % 900).alias("route_id"), (e % 5000).alias("trip_id"), (F.lit(-118.0) + e % 97 * 0.01).alias("lon"), (F.lit(34.0) + e % 89 * 0.01).alias("lat"), e.alias("timestamp"))


@query(f"WITH {_POS_SQL} SELECT vehicle_id, vehicle_label, route_id FROM pos WHERE chateau = 3 AND route_type IN (0, 1, 2)")
def vehicle_positions(t: Tables):
    """[D27]"""
    return reads.vehicles(_positions(t), chateau=3, route_types=[0, 1, 2]).select("vehicle_id", "vehicle_label", "route_id")


@query("SELECT c_nationkey AS chateau, count(*) AS n_routes, true AS changed FROM customer GROUP BY 1")
def route_cache(t: Tables):
    """A client that knows a route less than there are gets them all again. [D27]"""
    routes = t.customer.select(F.col("c_nationkey").alias("chateau"), F.col("c_custkey").alias("route_id"), "c_name")
    old = reads.route_cache(routes.where("route_id > 1 OR chateau % 2 = 0"), routes.limit(0).select("chateau", F.lit("").alias("hash")))
    short = routes.join(routes.groupBy("chateau").agg(F.max("route_id").alias("last")), "chateau").where("route_id < last").drop("last")
    known = reads.route_cache(short, old.limit(0).select("chateau", "hash")).select("chateau", "hash")
    return reads.route_cache(routes, known).select("chateau", "n_routes", "changed")


@query("""SELECT event_id AS update_id FROM events WHERE user_id % 1000 IN (SELECT c_custkey FROM customer WHERE c_custkey < 300) OR (event_id % 5 = 0 AND (user_id + 1) % 1000 IN (SELECT c_custkey FROM customer WHERE c_custkey < 300))""")
def updates_by_trip(t: Tables):
    """[D28]"""
    u = F.col("user_id")
    updates = t.events.select(F.col("event_id").alias("update_id"), (u % 1000).alias("trip_id"), F.when(F.col("event_id") % 5 == 0, (u + 1) % 1000).alias("modified_trip_id"))
    return reads.updates_of(updates, t.customer.where("c_custkey < 300").select(F.col("c_custkey").alias("trip_id")), "trip_id").select("update_id")


@query(f"""WITH {_POS_SQL}, r AS (SELECT c_custkey AS route_id FROM customer), c AS ({CALLS_SQL}), u AS (SELECT DISTINCT user_id % 900 AS route_id, event_id % 5000 AS trip_id FROM events WHERE event_type <> 'click'),
v AS (SELECT route_id, count(DISTINCT vehicle_id) AS n FROM pos GROUP BY 1), w AS (SELECT route_id, count(DISTINCT trip_id) AS n FROM u GROUP BY 1), s AS (SELECT route_id, count(DISTINCT stop_id) AS n FROM u JOIN c USING (trip_id) GROUP BY 1)
SELECT route_id, coalesce(v.n, 0) AS n_vehicles, coalesce(w.n, 0) AS n_trips, coalesce(s.n, 0) AS n_stops FROM r LEFT JOIN v USING (route_id) LEFT JOIN w USING (route_id) LEFT JOIN s USING (route_id)""")
def route_realtime(t: Tables):
    """[D30]"""
    positions = _positions(t)
    updates = t.events.where("event_type <> 'click'").select((F.col("user_id") % 900).alias("route_id"), (F.col("event_id") % 5000).alias("trip_id"))
    return reads.route_realtime(t.customer.select(F.col("c_custkey").alias("route_id")), positions, updates, views.calls(t))


@query(f"""WITH {_POS_SQL}, w AS (SELECT s_suppkey AS view_id, -118 + (s_suppkey % 10) * CAST(0.1 AS DOUBLE) - CAST(0.003 AS DOUBLE) AS west, 34 + (s_suppkey % 7) * CAST(0.1 AS DOUBLE) - CAST(0.003 AS DOUBLE) AS south FROM supplier)
SELECT view_id, vehicle_id FROM pos JOIN w ON lon BETWEEN west AND west + CAST(0.06 AS DOUBLE) AND lat BETWEEN south AND south + CAST(0.06 AS DOUBLE) AND vehicle_id % 3 = view_id % 3""")
def viewport_probe(t: Tables):
    """Each client's viewport against the vehicles of its kind. [J18, D26, D29]"""
    key = F.col("s_suppkey")
    west, south = F.lit(-118) + key % 10 * F.lit(0.1) - F.lit(0.003), F.lit(34) + key % 7 * F.lit(0.1) - F.lit(0.003)
    boxes = t.supplier.select(key.alias("view_id"), west.alias("west"), south.alias("south"), (west + F.lit(0.06)).alias("east"), (south + F.lit(0.06)).alias("north"))
    kind = lambda c: (F.col(c) % 3).alias("kind")
    return reads.in_viewport(_positions(t).select("vehicle_id", "lon", "lat", kind("vehicle_id")), boxes.select("*", kind("view_id")), on=("kind",)).select("view_id", "vehicle_id")


@query(f"SELECT brand FROM ({STOPS_SQL}) GROUP BY 1 HAVING min(lon) <= -117.99 AND max(lon) >= -118.2 AND min(lat) <= 34.01 AND max(lat) >= 33.5")
def hull_exists(t: Tables):
    """[J6]"""
    from tramline.operators.spatial import bounds

    return reads.touching(bounds(views.stops(t), ("brand",)), -118.2, 33.5, -117.99, 34.01).select("brand")


@query(f"""WITH cal AS (SELECT DISTINCT c.stop_id, t.route_id, t.route_id % 5 AS k FROM ({CALLS_SQL}) c JOIN ({TRIPS_SQL}) t USING (trip_id)) SELECT stop_id, string_agg(DISTINCT CAST(route_id AS VARCHAR), ',' ORDER BY CAST(route_id AS VARCHAR)) AS routes, array_to_string(list_sort(list(DISTINCT k)), ',') AS kinds FROM cal GROUP BY 1""")
def stop_routes(t: Tables):
    """[A8, O5]"""
    rows = views.calls(t).join(views.trips(t), "trip_id").select("stop_id", F.col("route_id").cast("string").alias("route_id"), (F.col("route_id") % 5).alias("route_type"))
    return reads.stop_routes(rows).select("stop_id", F.array_join("route_ids", ",").alias("routes"), F.array_join("route_types", ",").alias("kinds"))


@query(f"""WITH t AS ({TRIPS_SQL}), p AS (SELECT DISTINCT trip_id % 500 AS shape_id, route_id FROM t) SELECT shape_id, array_to_string(list_sort(list(route_id)), ',') AS routes, min_by('c' || route_id, route_id) FILTER (route_id % 3 = 0) AS colour FROM p GROUP BY 1""")
def shape_colours(t: Tables):
    """[A23]"""
    routes = t.orders.select(F.col("o_custkey").alias("route_id")).distinct().withColumn("colour", F.when(F.col("route_id") % 3 == 0, F.concat(F.lit("c"), "route_id")))
    out = reads.shape_colours(views.trips(t).withColumn("shape_id", F.col("trip_id") % 500), routes)
    return out.select("shape_id", F.array_join("route_ids", ",").alias("routes"), "colour")


@query(f"""WITH a AS (SELECT DISTINCT stop_id // 6 AS osm_id, stop_id, route_id, route_id % 4 AS k FROM ({CALLS_SQL}) c JOIN ({TRIPS_SQL}) t USING (trip_id)), s AS (SELECT DISTINCT stop_id // 6 AS osm_id FROM ({STOPS_SQL})), n AS (SELECT stop_id // 6 AS osm_id, count(*) AS n FROM ({STOPS_SQL}) GROUP BY 1)
SELECT s.osm_id, n.n AS n_stops, count(DISTINCT route_id) AS n_routes, coalesce(array_to_string(list_sort(list(DISTINCT k) FILTER (k IS NOT NULL)), ','), '') AS kinds FROM s JOIN n USING (osm_id) LEFT JOIN a USING (osm_id) GROUP BY 1, 2""")
def station_preview(t: Tables):
    """[D31, D7]"""
    stops = views.stops(t).select("stop_id", F.floor(F.col("stop_id") / 6).alias("osm_id"))
    routes = views.calls(t).join(views.trips(t), "trip_id").select("stop_id", "route_id", (F.col("route_id") % 4).alias("route_type")).distinct()
    return reads.station_preview(stops.select("osm_id").distinct(), stops, routes).select("osm_id", "n_stops", "n_routes", F.array_join("route_types", ",").alias("kinds"))


@query("""SELECT n_regionkey AS chateau, n_nationkey AS agency_id, n_name AS name, (SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS routes FROM nation WHERE n_regionkey IN (1, 2)""")
def agencies_of(t: Tables):
    """[D36, D48]"""
    agencies = t.nation.select(F.col("n_regionkey").alias("chateau"), F.col("n_nationkey").alias("agency_id"), F.col("n_name").alias("name"))
    routes = t.customer.join(agencies, F.col("c_nationkey") == F.col("agency_id")).select("chateau", "agency_id", F.col("c_custkey").alias("route_id"))
    out = reads.agencies_of(agencies, routes, t.region.where("r_regionkey IN (1, 2)").select(F.col("r_regionkey").alias("chateau")))
    return out.select("chateau", "agency_id", "name", F.array_join("route_ids", ",").alias("routes"))


@query(f"""WITH {_POS_SQL}, l AS (SELECT s_suppkey % 7 AS chateau, 'v' || s_suppkey AS vehicle_label FROM supplier), f AS (SELECT n_nationkey AS fleet, n_nationkey * 100 AS a, n_nationkey * 100 + 79 AS b, n_nationkey % 7 AS chateau FROM nation),
p AS (SELECT chateau, vehicle_label, max_by(trip_id, timestamp) AS trip_id, max_by(lon, timestamp) AS lon FROM pos GROUP BY 1, 2)
SELECT l.chateau, l.vehicle_label, lon, trip_id, o_custkey AS route_id FROM l LEFT JOIN p USING (chateau, vehicle_label) LEFT JOIN orders ON trip_id = o_orderkey""")
def vehicle_card(t: Tables):
    """[D50]"""
    labels = t.supplier.select((F.col("s_suppkey") % 7).alias("chateau"), F.concat(F.lit("v"), "s_suppkey").alias("vehicle_label"))
    key = F.col("n_nationkey")
    fleet = t.nation.select(key.alias("fleet"), (key * 100).alias("starting_range"), (key * 100 + 79).alias("ending_range"), (key % 7).alias("chateau"))
    return reads.vehicle_card(labels, _positions(t), fleet, views.trips(t)).select("chateau", "vehicle_label", "lon", "trip_id", "route_id")


@query(f"SELECT chateau, stop_id, count(*) AS n FROM (SELECT t.route_id % 3 AS chateau, c.stop_id FROM ({CALLS_SQL}) c JOIN ({TRIPS_SQL}) t USING (trip_id)) WHERE (chateau, stop_id) IN (SELECT p_partkey % 3, p_partkey FROM part) GROUP BY 1, 2")
def tenants_union(t: Tables):
    """Look-ups of several tenants as one plan keyed by tenant. [J22, P1]"""
    calls = views.calls(t).join(views.trips(t), "trip_id").select((F.col("route_id") % 3).alias("chateau"), "stop_id")
    asked = t.part.select((F.col("p_partkey") % 3).alias("chateau"), F.col("p_partkey").alias("stop_id"))
    return calls.join(asked, ["chateau", "stop_id"], "left_semi").groupBy("chateau", "stop_id").agg(F.count("*").alias("n"))
