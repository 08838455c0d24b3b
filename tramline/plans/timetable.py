"""Calendars, patterns, boards and realtime over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions.clock import wall_seconds
from tramline.operators import calendar, departures, realtime, timetable
from tramline.plans import views
from tramline.plans.registry import Tables, query
from tramline.plans.views import CALLS_SQL, STOPS_SQL, TRIPS_SQL

_CALENDAR_SQL = """calendar AS (SELECT c_custkey AS service_id, CAST(c_custkey % 127 + 1 AS INTEGER) AS mask, DATE '1996-01-01' + CAST(c_custkey % 30 AS INTEGER) AS start_date,
  DATE '1996-01-29' + CAST(c_custkey % 30 AS INTEGER) AS end_date FROM customer),
exceptions AS (SELECT o_custkey AS service_id, DATE '1996-01-01' + CAST(o_orderkey % 45 AS INTEGER) AS date, CAST(1 + o_orderkey % 2 AS INTEGER) AS exception_type FROM orders),
usual AS (SELECT service_id, CAST(d AS DATE) AS date FROM (SELECT *, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS d FROM calendar) WHERE (mask >> (CAST(isodow(d) AS INTEGER) - 1)) & 1 = 1),
days AS (SELECT service_id, date FROM (SELECT service_id, date FROM usual UNION SELECT service_id, date FROM exceptions WHERE exception_type = 1)
  EXCEPT SELECT service_id, date FROM exceptions WHERE exception_type = 2)"""


def _days(t: Tables):
    day = lambda n: F.date_add(F.lit("1996-01-01").cast("date"), n.cast("int"))
    key = F.col("c_custkey")
    own = t.customer.select(key.alias("service_id"), (key % 127 + 1).cast("int").alias("mask"), day(key % 30).alias("start_date"), day(key % 30 + 28).alias("end_date"))
    special = t.orders.select(F.col("o_custkey").alias("service_id"), day(F.col("o_orderkey") % 45).alias("date"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("exception_type"))
    return calendar.service_days(own, special)


@query(f"WITH {_CALENDAR_SQL} SELECT service_id, date FROM days")
def service_days(t: Tables):
    return _days(t)


@query(f"""WITH {_CALENDAR_SQL},
span AS (SELECT service_id, min(date) AS start_date, max(date) AS end_date FROM days GROUP BY 1),
grid AS (SELECT service_id, CAST(d AS DATE) AS date FROM (SELECT service_id, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS d FROM span)),
mark AS (SELECT g.service_id, CAST(isodow(g.date) AS INTEGER) - 1 AS wd, d.date IS NOT NULL AS runs FROM grid g LEFT JOIN days d ON g.service_id = d.service_id AND g.date = d.date),
sums AS (SELECT service_id, wd, count(*) FILTER (runs) AS ran, count(*) FILTER (NOT runs) AS idle FROM mark GROUP BY 1, 2),
tried AS (SELECT service_id, m AS mask, sum(CASE WHEN (m >> wd) & 1 = 1 THEN 0 ELSE ran END) AS n_added, sum(CASE WHEN (m >> wd) & 1 = 1 THEN idle ELSE 0 END) AS n_removed FROM sums, (SELECT unnest(range(128)) AS m) GROUP BY 1, 2),
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY n_added + n_removed, mask) = 1)
SELECT b.service_id, CAST(mask AS INTEGER) AS mask, start_date, end_date, CAST(n_added AS BIGINT) AS n_added, CAST(n_removed AS BIGINT) AS n_removed FROM best b JOIN span USING (service_id)""")
def optimal_calendar(t: Tables):
    return calendar.optimal_calendar(_days(t))


@query(f"""WITH {_CALENDAR_SQL}, sets AS (SELECT service_id, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates FROM days GROUP BY 1)
SELECT service_id, min(service_id) OVER (PARTITION BY dates) AS canonical FROM sets""")
def equivalent_services(t: Tables):
    return calendar.equivalent_services(_days(t))


@query(f"WITH {_CALENDAR_SQL} SELECT service_id, min(date) AS first_date, max(date) AS last_date FROM days GROUP BY 1")
def feed_span(t: Tables):
    return calendar.feed_span(_days(t), ("service_id",))


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS date,
  CAST(epoch(timezone('America/Los_Angeles', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR)) AS BIGINT) - 43200 AS midnight FROM orders""")
def service_instants(t: Tables):
    return calendar.service_instants(t.orders.select(F.to_date("o_orderdate").alias("date")).distinct(), "America/Los_Angeles")


#: Two stops and times of a fixed rhythm, so that patterns are shared.
_SHARED_SQL = f"""trips AS ({TRIPS_SQL}), calls AS (SELECT trip_id, stop_id % 2 AS stop_id, stop_sequence, stop_sequence * 300 + (trip_id % 2) * 60 * (stop_sequence - 1) AS arrival,
  stop_sequence * 300 + (trip_id % 2) * 60 * (stop_sequence - 1) + 30 AS departure FROM ({CALLS_SQL}))"""


def _compressed(t: Tables):
    trips = views.trips(t).select("trip_id", F.lit(1).alias("route_id"), "service_id", F.lit(0).alias("direction_id"), "headsign", F.lit(None).cast("string").alias("shape_id"))
    at = F.col("stop_sequence") * 300 + F.col("trip_id") % 2 * 60 * (F.col("stop_sequence") - 1)
    return timetable.compress(trips, views.calls(t).withColumn("stop_id", F.col("stop_id") % 2).withColumn("arrival", at).withColumn("departure", at + 30))


@query(f"""WITH {_SHARED_SQL},
listed AS (SELECT trip_id, count(*) AS n, string_agg(CAST(stop_id AS VARCHAR), '>' ORDER BY stop_sequence) AS stops, string_agg(CAST(arrival AS VARCHAR), ',' ORDER BY stop_sequence) AS times FROM calls GROUP BY 1)
SELECT headsign, stops, count(*) AS n_trips, max(n) AS n_calls FROM trips t JOIN listed l ON t.trip_id = l.trip_id WHERE n >= 2 GROUP BY headsign, stops, times""")
def pattern_compress(t: Tables):
    trips, itineraries, directions = _compressed(t)
    sizes = itineraries.groupBy("pattern_id", "direction_pattern_id").agg(F.count("*").alias("n_calls"))
    counts = trips.groupBy("pattern_id").agg(F.count("*").alias("n_trips"))
    joined = counts.join(sizes, "pattern_id").join(directions, "direction_pattern_id")
    return joined.select("headsign", F.array_join("stop_ids", ">").alias("stops"), "n_trips", "n_calls")


@query(f"""WITH {_SHARED_SQL}, n AS (SELECT trip_id FROM calls GROUP BY 1 HAVING count(*) >= 2)
SELECT c.trip_id, stop_sequence - 1 AS stop_sequence, stop_id, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) + arrival AS arrival, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) + departure AS departure
FROM calls c JOIN n ON c.trip_id = n.trip_id JOIN trips t ON c.trip_id = t.trip_id""")
def timetable_decompress(t: Tables):
    packed, itineraries, _ = _compressed(t)
    dated = packed.join(views.trips(t).select("trip_id", "date"), "trip_id")
    days = dated.select(F.col("trip_id").alias("service_id"), "date").withColumn("midnight", wall_seconds(F.col("date").cast("timestamp_ntz")))
    return timetable.decompress(packed.withColumn("service_id", F.col("trip_id")), itineraries, days).drop("date")


@query("""SELECT DISTINCT trip_id, unnest(range(s, e, h)) AS start_time FROM (
  SELECT p_partkey AS trip_id, 21600 + (p_partkey % 5) * 600 AS s, 21600 + (p_partkey % 5) * 600 + p_size * 300 AS e, 300 + (p_partkey % 4) * 300 AS h FROM part)""")
def frequency_expand(t: Tables):
    key = F.col("p_partkey")
    begin = 21_600 + key % 5 * 600
    return timetable.expand_frequencies(t.part.select(key.alias("trip_id"), begin.alias("start_time"), (begin + F.col("p_size") * 300).alias("end_time"), (300 + key % 4 * 300).alias("headway_secs")))


@query(f"""WITH c AS (SELECT trip_id, stop_sequence, CASE WHEN stop_sequence % 3 = 1 THEN arrival END AS time FROM ({CALLS_SQL})),
k AS (SELECT *, max(CASE WHEN time IS NOT NULL THEN stop_sequence END) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS an,
  min(CASE WHEN time IS NOT NULL THEN stop_sequence END) OVER (PARTITION BY trip_id ORDER BY stop_sequence ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bn FROM c)
SELECT k.trip_id, k.stop_sequence, CAST(coalesce(k.time, a.time + (k.stop_sequence - k.an) * CAST(floor((b.time - a.time) / (k.bn - k.an - 1)) AS INTEGER)) AS INTEGER) AS time
FROM k LEFT JOIN c a ON a.trip_id = k.trip_id AND a.stop_sequence = k.an LEFT JOIN c b ON b.trip_id = k.trip_id AND b.stop_sequence = k.bn""")
def interpolate_gaps(t: Tables):
    gaps = views.calls(t).select("trip_id", "stop_sequence", F.when(F.col("stop_sequence") % 3 == 1, F.col("arrival")).alias("time"))
    return timetable.interpolate(gaps)


@query(f"""SELECT trip_id, stop_sequence, stop_sequence - 1 AS ordinal, stop_sequence = 1 AS is_first, stop_sequence = max(stop_sequence) OVER (PARTITION BY trip_id) AS is_last FROM ({CALLS_SQL})""")
def trip_ends(t: Tables):
    return timetable.ends(views.calls(t)).select("trip_id", "stop_sequence", "ordinal", "is_first", "is_last")


@query(f"""WITH c AS ({CALLS_SQL}) SELECT c.stop_id, count(DISTINCT (t.route_id, t.headsign)) AS n_terminal_routes FROM c JOIN ({TRIPS_SQL}) t ON c.trip_id = t.trip_id
WHERE c.stop_sequence = (SELECT min(stop_sequence) FROM c x WHERE x.trip_id = c.trip_id) OR c.stop_sequence = (SELECT max(stop_sequence) FROM c x WHERE x.trip_id = c.trip_id) GROUP BY 1""")
def terminal_routes(t: Tables):
    ends = timetable.terminals(views.calls(t)).join(views.trips(t), "trip_id")
    return ends.groupBy("stop_id").agg(F.count_distinct("route_id", "headsign").alias("n_terminal_routes"))


@query(f"""WITH w AS (SELECT stop_id, lag(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS p, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS n FROM ({CALLS_SQL})),
e AS (SELECT stop_id, unnest([p, n]) AS o FROM w) SELECT stop_id, count(DISTINCT o) AS degree FROM e WHERE o IS NOT NULL AND o <> stop_id GROUP BY 1""")
def adjacency_degree(t: Tables):
    from tramline.operators.ranking import degree

    return degree(timetable.neighbours(views.calls(t)), distinct=True)


_BOARD_SQL = f"""trips AS ({TRIPS_SQL}), calls AS ({CALLS_SQL}), stops AS ({STOPS_SQL}),
sched AS (SELECT c.trip_id, t.date, c.stop_sequence, c.stop_id, CAST(epoch(CAST(t.date AS TIMESTAMP)) AS BIGINT) + t.start_time + c.arrival AS arrival,
  CAST(epoch(CAST(t.date AS TIMESTAMP)) AS BIGINT) + t.start_time + c.departure AS departure, t.headsign FROM calls c JOIN trips t ON c.trip_id = t.trip_id),
upd AS (SELECT trip_id, date, CASE WHEN trip_id % 97 = 0 THEN 'CANCELED' ELSE 'SCHEDULED' END AS trip_status, CASE WHEN trip_id % 11 = 3 AND stop_sequence = 2 THEN 'SKIPPED' END AS stop_status,
  stop_sequence, CASE WHEN stop_sequence % 2 = 1 THEN departure + (trip_id % 600) END AS rt_departure, arrival + (trip_id % 600) AS rt_arrival FROM sched WHERE trip_id % 3 = 0),
laid AS (SELECT s.*, CASE WHEN u.rt_departure IS NOT NULL THEN u.rt_arrival END AS realtime_arrival, coalesce(u.rt_departure, u.rt_arrival) AS realtime_departure,
  coalesce(u.trip_status = 'CANCELED', false) AS trip_cancelled, coalesce(u.stop_status = 'SKIPPED', false) AS stop_cancelled
  FROM sched s LEFT JOIN upd u ON s.trip_id = u.trip_id AND s.date = u.date AND s.stop_sequence = u.stop_sequence)"""
_FROM, _TO = 820_454_400, 828_230_400  # the first quarter of 1996


def _scheduled(t: Tables):
    midnight = wall_seconds(F.col("date").cast("timestamp_ntz"))
    joined = views.calls(t).join(views.trips(t), "trip_id")
    return joined.select("trip_id", "date", "stop_sequence", "stop_id", (midnight + F.col("start_time") + F.col("arrival")).alias("arrival"), (midnight + F.col("start_time") + F.col("departure")).alias("departure"), "headsign")


def _updates(scheduled):
    late = F.col("trip_id") % 600
    return scheduled.where("trip_id % 3 = 0").select(
        "trip_id", "date", F.lit(None).cast("long").alias("stop_id"), "stop_sequence",
        F.when(F.col("trip_id") % 97 == 0, "CANCELED").otherwise("SCHEDULED").alias("trip_status"),
        F.when((F.col("trip_id") % 11 == 3) & (F.col("stop_sequence") == 2), "SKIPPED").alias("stop_status"),
        F.when(F.col("stop_sequence") % 2 == 1, F.col("departure") + late).alias("rt_departure"), (F.col("arrival") + late).alias("rt_arrival"),
        F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("vehicle"),
    )


_LAID = ["trip_id", "stop_sequence", "stop_id", "arrival", "departure", "realtime_arrival", "realtime_departure", "trip_cancelled", "stop_cancelled"]


@query(f"WITH {_BOARD_SQL} SELECT {', '.join(_LAID)} FROM laid")
def rt_overlay(t: Tables):
    scheduled = _scheduled(t)
    return realtime.overlay(scheduled, _updates(scheduled)).select(*_LAID)


@query(f"""WITH {_BOARD_SQL}, wanted AS (SELECT stop_id FROM stops)
SELECT {', '.join(_LAID)}, headsign, coalesce(realtime_departure, realtime_arrival, departure, arrival, 0) AS sort_time FROM laid
WHERE stop_id IN (SELECT stop_id FROM wanted) AND (coalesce(realtime_departure BETWEEN {_FROM} AND {_TO}, false) OR coalesce(realtime_arrival BETWEEN {_FROM} AND {_TO}, false)
  OR departure BETWEEN {_FROM} AND {_TO} OR arrival BETWEEN {_FROM} AND {_TO})""")
def departures_at_stop(t: Tables):
    """Only trips near the window, and of them only calls at the stops, are joined and laid over. [D6, J3, O1, P10]"""
    wanted = views.stops(t).select("stop_id")
    near = F.col("date").between(F.to_date(F.timestamp_seconds(F.lit(_FROM - 3 * 86_400))), F.to_date(F.timestamp_seconds(F.lit(_TO + 86_400))))
    scheduled = _scheduled(t).where(near)
    at_stops = scheduled.join(wanted, "stop_id", "left_semi")
    return departures.board(realtime.overlay(at_stops, _updates(at_stops)), wanted, _FROM, _TO).select(*_LAID, "headsign", "sort_time")


@query(f"""WITH {_BOARD_SQL}, al AS (SELECT e.event_id, 1 + e.event_id % 2 AS effect, e.user_id AS stop_id, 820454400 + (e.event_id % 60) * 86400 AS a, 820454400 + (e.event_id % 60) * 86400 + 40 * 86400 AS b FROM events e)
SELECT trip_id, stop_sequence, stop_id, trip_cancelled, stop_cancelled OR EXISTS (SELECT 1 FROM al WHERE effect = 1 AND al.stop_id = laid.stop_id AND a <= departure AND b >= departure) AS stop_cancelled FROM laid""")
def alert_overlay(t: Tables):
    scheduled = _scheduled(t)
    begin = 820_454_400 + F.col("event_id") % 60 * 86_400
    alerts = t.events.select((F.col("event_id") % 2 + 1).alias("effect"), F.col("user_id").alias("stop_id"), begin.alias("start"), (begin + 40 * 86_400).alias("end"))
    return departures.cancelled_by_alert(realtime.overlay(scheduled, _updates(scheduled)), alerts).select("trip_id", "stop_sequence", "stop_id", "trip_cancelled", "stop_cancelled")


@query(f"""WITH calls AS ({CALLS_SQL}) SELECT e.event_id, e.event_id + 10000 AS trip_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.event_id + 10000) AND e.event_id % 3000 IN (SELECT stop_id FROM calls)""")
def added_trips(t: Tables):
    updates = t.events.select("event_id", (F.col("event_id") + 10_000).alias("trip_id"), (F.col("event_id") % 3000).alias("stop_id"))
    return realtime.added_trips(updates, t.orders.select(F.col("o_orderkey").alias("trip_id")), views.calls(t)).select("event_id", "trip_id")


@query(f"""WITH u AS (SELECT trip_id, stop_id, stop_sequence, arrival, departure, CASE WHEN stop_sequence % 5 = 2 THEN 'SKIPPED' END AS status FROM ({CALLS_SQL}))
SELECT trip_id, stop_id, arrival FROM u WHERE coalesce(status, '') <> 'SKIPPED' QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY
  CASE WHEN arrival <= 1000 AND departure >= 1000 THEN 0 WHEN arrival > 1000 THEN 1 ELSE 2 END, CASE WHEN arrival > 1000 OR departure >= 1000 THEN arrival ELSE -departure END, stop_id) = 1""")
def closest_update(t: Tables):
    updates = views.calls(t).withColumn("status", F.when(F.col("stop_sequence") % 5 == 2, "SKIPPED"))
    return realtime.closest_update(updates, F.lit(1000)).select("trip_id", "stop_id", "arrival")


@query("""WITH ev AS (SELECT o_orderkey AS event_id, o_custkey AS service_id, CAST(o_orderdate AS DATE) AS observed FROM orders),
days AS (SELECT DISTINCT o_custkey AS service_id, CAST(o_orderdate AS DATE) + 3 AS date FROM orders)
SELECT event_id, d.date FROM ev JOIN days d ON ev.service_id = d.service_id AND d.date BETWEEN observed - 10 AND observed + 9
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(d.date - observed), d.date) = 1""")
def service_date_asof(t: Tables):
    seen = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("service_id"), F.to_date("o_orderdate").alias("observed"))
    days = t.orders.select(F.col("o_custkey").alias("service_id"), F.date_add(F.to_date("o_orderdate"), 3).alias("date")).distinct()
    return realtime.nearest_service_date(seen, days).select("event_id", "date")


@query("""WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS d, CAST(epoch(ts) AS BIGINT) % 86400 AS el, (event_id * 7919) % 129600 AS st FROM events),
c AS (SELECT e.*, o FROM e, (SELECT unnest(range(-4, 2)) AS o) WHERE o * 86400 + st <= el + 7200)
SELECT e.event_id, coalesce(e.d + CAST((SELECT max(o) FROM c WHERE c.event_id = e.event_id) AS INTEGER), e.d) AS date FROM e""")
def operation_date(t: Tables):
    return t.events.select("event_id", realtime.operation_date(F.col("ts"), F.col("event_id") * 7919 % 129_600).alias("date"))


@query(f"""WITH u AS (SELECT trip_id, stop_id, arrival + trip_id % 300 AS rt_time, arrival AS due, CASE WHEN trip_id % 5 = 0 THEN trip_id % 60 END AS delay FROM ({CALLS_SQL})),
f AS (SELECT trip_id, rt_time - due AS found FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY rt_time, stop_id) AS r FROM u WHERE rt_time >= 700) WHERE r = 1)
SELECT g.trip_id, coalesce(given, found) AS delay FROM (SELECT trip_id, max(delay) AS given FROM u GROUP BY 1) g LEFT JOIN f ON g.trip_id = f.trip_id""")
def stop_delay(t: Tables):
    calls = views.calls(t).withColumn("stop_id", F.struct("stop_id", "stop_sequence"))
    updates = calls.select("trip_id", "stop_id", (F.col("arrival") + F.col("trip_id") % 300).alias("rt_time"), F.when(F.col("trip_id") % 5 == 0, F.col("trip_id") % 60).alias("delay"))
    return realtime.delay(updates, calls.select("trip_id", "stop_id", F.col("arrival").alias("time")), F.lit(700))


@query(f"""WITH c AS (SELECT DISTINCT trip_id, CAST(stop_id AS VARCHAR) AS stop_id FROM ({CALLS_SQL})),
u AS (SELECT trip_id, CASE WHEN stop_sequence % 3 = 0 THEN stop_id || '_7' WHEN stop_sequence % 3 = 1 THEN stop_id ELSE 'x' || stop_id END AS rt_stop_id FROM (SELECT trip_id, stop_sequence, CAST(stop_id AS VARCHAR) AS stop_id FROM ({CALLS_SQL})) s),
p AS (SELECT 'x' || CAST(p_partkey AS VARCHAR) AS stop_id, CAST(p_partkey AS VARCHAR) AS parent FROM part WHERE p_partkey % 2 = 0),
o AS (SELECT trip_id, rt_stop_id, 0 AS kind, rt_stop_id AS k FROM u UNION ALL SELECT trip_id, rt_stop_id, 1, parent FROM u JOIN p ON u.rt_stop_id = p.stop_id
  UNION ALL SELECT trip_id, rt_stop_id, 2, regexp_extract(rt_stop_id, '^(.+)_[^_]*$', 1) FROM u WHERE rt_stop_id LIKE '%\\_%' ESCAPE '\\')
SELECT o.trip_id, rt_stop_id, min_by(c.stop_id, (kind, c.stop_id)) AS stop_id FROM o JOIN c ON o.trip_id = c.trip_id AND o.k = c.stop_id GROUP BY 1, 2""")
def stop_match(t: Tables):
    calls = views.calls(t).withColumn("stop_id", F.col("stop_id").cast("string"))
    third = F.col("stop_sequence") % 3
    updates = calls.select("trip_id", F.when(third == 0, F.concat("stop_id", F.lit("_7"))).when(third == 1, F.col("stop_id")).otherwise(F.concat(F.lit("x"), "stop_id")).alias("rt_stop_id"))
    parents = t.part.where("p_partkey % 2 = 0").select(F.concat(F.lit("x"), "p_partkey").alias("stop_id"), F.col("p_partkey").cast("string").alias("parent_station"))
    return realtime.matched_stops(updates, calls, parents)


@query(f"""WITH trips AS ({TRIPS_SQL}), calls AS ({CALLS_SQL}) SELECT t.trip_id, t.route_id, min_by(c.stop_id, c.stop_sequence) AS first_stop, max_by(c.stop_id, c.stop_sequence) AS last_stop, min(c.departure) AS starts, max(c.arrival) AS ends
FROM trips t JOIN calls c ON t.trip_id = c.trip_id WHERE t.block_id = 7 GROUP BY 1, 2""")
def block_trips(t: Tables):
    return departures.block(views.trips(t), views.calls(t), 7).select("trip_id", "route_id", "first_stop", "last_stop", "starts", "ends")
