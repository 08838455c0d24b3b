"""Plans and results that must hold at any size: rows at one place, no exploded side sent to every task."""

import random
from datetime import date

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType
from test_operators import rows

from tramline.functions import lines, udfs
from tramline.functions.protobuf import packed
from tramline.operators import calendar, departures, ranking, reads, realtime, spatial, structure, timetable
from tramline.plans import QUERIES
from tramline.sources import realtime as realtime_source


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowd(spark, n=40):
    """``n`` rows on each of three places, 100 metres apart."""
    return spark.range(3 * n).select("id", (F.lit(8.0) + F.col("id") % 3 * 0.0014).alias("lon"), F.lit(50.0).alias("lat"))


def test_nearest_rows_meet_by_position(spark):
    left = crowd(spark)
    right = left.toDF("r_id", "r_lon", "r_lat")
    found = spatial.nearest_k(left, right, 150, "id", "r_id", 2)
    assert "Broadcast" not in plan(found) and "Broadcast" not in plan(spatial.nearest_within(left, right, 150, "id", "r_id"))
    assert {(i, r, k) for i, r, _, k in rows(found)} == {(i, i % 3 + 3 * (k - 1), k) for i in range(120) for k in (1, 2)}
    assert {(i, r) for i, r, _ in rows(spatial.nearest_within(left, right, 150, "id", "r_id"))} == {(i, i % 3) for i in range(120)}


def test_connections_meet_by_position(spark):
    base = crowd(spark).select(F.col("id").alias("stop_id"), "lon", "lat", F.lit(3).alias("route_type"))
    others = crowd(spark, 60).toDF("other_id", "r_lon", "r_lat").withColumn("r_type", F.lit(3))
    found = reads.connections(base, others)
    assert "Broadcast" not in plan(found)
    assert {(i, s) for i, s, _ in rows(found)} == {(i, i if i < 120 else i % 3) for i in range(180)}


def test_radius_join_takes_distances_by_position(spark):
    left = crowd(spark)
    found = spatial.radius_join(left, left.toDF("r_id", "r_lon", "r_lat"), 150)
    assert "Broadcast" not in plan(found) and found.columns == ["id", "lon", "lat", "r_id", "r_lon", "r_lat", "metres"]
    assert {(r.id, r.r_id) for r in found.collect()} == {(a, b) for a in range(120) for b in range(120) if abs(a % 3 - b % 3) <= 1}


def test_ip_ranges_end_at_the_last_address(spark, tmp_path):
    spark.createDataFrame([(7,), (25,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1,), (42_949,), (42_950,), (42_951,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    assert rows(QUERIES["ip_location"](spark, str(tmp_path))) == []  # past 2^32 addresses don't begin at 0 again
    spark.createDataFrame([((1 << 32) // 7919,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"), mode="overwrite")
    assert rows(QUERIES["ip_location"](spark, str(tmp_path))) == [((1 << 32) // 7919 * 7919, 42_949)]  # a range across the end


def test_operation_date_rounds_to_seconds(spark):
    seen = spark.sql("SELECT timestamp_ntz'2024-01-05 00:00:09.7' AS ts, 7210 AS s UNION ALL SELECT timestamp_ntz'2024-01-05 00:00:09.4', 7210")
    got = sorted(str(r.d) for r in seen.select(realtime.operation_date(F.col("ts"), F.col("s")).alias("d")).collect())
    assert got == ["2024-01-04", "2024-01-05"]


def test_service_days_meet_events_unmultiplied(spark):
    events = spark.createDataFrame([(1, "a", "2024-01-10"), (2, "a", "2024-02-20"), (3, "b", "2024-01-01"), (4, "c", "2024-01-01")], "event_id int, service_id string, observed string").withColumn("observed", F.to_date("observed"))
    days = spark.createDataFrame([("a", "2024-01-08"), ("a", "2024-01-12"), ("a", "2024-02-10"), ("b", "2024-01-11")], "service_id string, date string").withColumn("date", F.to_date("date"))
    found = realtime.nearest_service_date(events, days)
    assert "Generate" not in plan(found) and "Broadcast" not in plan(found)
    assert [(r.event_id, str(r.date)) for r in found.orderBy("event_id").collect()] == [(1, "2024-01-08"), (2, "2024-02-10")]


def test_train_trips_pair_by_stop_or_by_start(spark):
    trains = spark.createDataFrame([(1, 5, "X", [9, 8], 100), (2, 5, "x", [1], 100), (3, 5, "Z", [1], 100), (4, 6, "x", [1], 100), (5, 5, None, [1], 90), (6, 5, "q", [8], None)], "train_id long, number int, headsign string, stop_ids array<int>, time int")
    trips = spark.createDataFrame([(1, 5, "s", "y", [9, 8], 900), (2, 5, "s", "X", [8], 100), (3, 5, "s", "X", [7], 200), (4, 5, "s", "x", [7], 0), (5, 5, "s", "y", [7], 110), (6, 5, "s", "w", [7], 90), (7, 5, "off", "x", [1], 100)], "trip_id long, number int, service_id string, headsign string, stop_ids array<int>, start_time int")
    found = realtime.train_trips(trains, trips, spark.createDataFrame([("s",)], "service_id string"))
    assert rows(found.select("train_id", "trip_id").na.fill(-1)) == [(1, 1), (2, 2), (3, 2), (4, -1), (5, 6), (6, 1)]


def test_viewports_meet_by_cells_of_their_size(spark):
    points = spark.range(400).select("id", (F.col("id") % 20 * 0.01).alias("lon"), (F.floor(F.col("id") / 20) * 0.01).alias("lat"), (F.col("id") % 2).alias("kind"))
    views = spark.createDataFrame([(1, 0.005, 0.005, 0.035, 0.035, 0), (2, -50.0, -50.0, 50.0, 50.0, 1), (3, 179.0, -1.0, 0.02, 0.0, 1), (4, 0.03, 0.03, 0.03, 0.03, 1)], "view_id int, west double, south double, east double, north double, kind long")
    found = reads.in_viewport(points, views, on=("kind",))
    near = points.crossJoin(views.withColumnRenamed("kind", "k")).where("kind = k AND lat BETWEEN south AND north AND (lon BETWEEN west AND east OR west > east AND (lon >= west OR lon <= east))")
    assert rows(found.select("id", "view_id")) == rows(near.select("id", "view_id")) and found.count() > 200
    assert all(k in plan(found) for k in ("SortMergeJoin", "kind"))


def test_days_and_starts_are_not_hashed_one_by_one(spark):
    own = spark.createDataFrame([("a", 127, "2024-01-01", "2024-01-03"), ("a", 127, "2024-01-02", "2024-01-04"), ("n", None, "2024-01-01", "2024-01-02")], "service_id string, mask int, start_date string, end_date string").withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})
    special = spark.createDataFrame([("a", "2024-01-03", 2), ("a", "2024-01-03", 1), ("a", "2024-01-09", 1), ("b", "2024-01-05", 1), ("b", "2024-01-06", 3)], "service_id string, date string, exception_type int").withColumn("date", F.to_date("date"))
    days = calendar.service_days(own, special)
    assert [(r.service_id, r.date.day) for r in days.orderBy("service_id", "date").collect()] == [("a", 1), ("a", 2), ("a", 4), ("a", 9), ("b", 5)]
    assert plan(days).count("Exchange") == 1 and plan(days).index("Generate") < plan(days).index("Exchange")  # days come after the shuffle
    starts = timetable.expand_frequencies(spark.createDataFrame([("t", 0, 100, 50), ("t", 50, 101, 50), ("u", 5, 5, 1)], "trip_id string, start_time long, end_time long, headway_secs long"))
    assert rows(starts) == [("t", 0), ("t", 50), ("t", 100)] and plan(starts).index("Generate") < plan(starts).index("Exchange")


def test_ranks_are_counted_on_written_scores(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("score"), (F.col("id") % 2 == 0).alias("is_rail"))
    found = ranking.ranked(df, ["is_rail"], [F.col("score"), F.col("id")])
    assert "percentile_approx" not in plan(found)  # taken once, not again in each branch
    assert sorted(r.position for r in found.where("is_rail").collect()) == list(range(1, 101))


def test_entities_are_handed_on_in_parts(spark):
    class Messages:
        dtypes, select, mapInArrow = [("feed_id", "bigint")], lambda self, *_: self, lambda self, run, schema: run

    run = realtime_source.entities(Messages(), "vehicle")
    entity = lambda n: packed((1, f"v{n}"), (4, packed((5, n + 1))))
    broken = packed((1, "x"), (4, b"\xff"))
    bodies = [realtime_source.feed_bytes(1, [entity(n) for n in range(2_500)]), None, b"\xff", realtime_source.feed_bytes(1, [entity(7), broken, entity(8)]), realtime_source.feed_bytes(1, [entity(9)])]
    out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(bodies, pa.binary())], ["feed_id", "body"])])))
    assert max(b.num_rows for b in out) <= 1_000
    assert [(r["feed_id"], r["entity_id"]) for b in out for r in b.to_pylist()] == [(0, f"v{n}") for n in range(2_500)] + [(3, "v7"), (4, "v9")]


def test_lines_are_cut_once_for_each_pair_of_places(spark):
    calls = spark.createDataFrame([(t, n, n * 0.2, 1.0, 100 * n, 100 * n, [1, None][t % 2]) for t in range(300) for n in (1, 2, 3)], "trip_id long, stop_sequence int, lon double, lat double, departure int, arrival int, shape_id int")
    lines = spark.createDataFrame([(1, [(i * 0.1, 1.0) for i in range(9)])], "shape_id int, points array<struct<lon:double,lat:double>>")
    legs, patterns = structure.trajectories(calls, lines)
    assert "array_min" not in plan(legs) and "array_min" not in plan(patterns)
    found = legs.join(patterns, "pattern_id").select("trip_id", "leg", "starts", "ends", F.size("points").alias("n")).collect()
    assert sorted(map(tuple, found)) == [(t, n, 100 * n, 100 * n + 100, 2 if t % 2 else 3) for t in range(300) for n in (1, 2)]
    assert patterns.count() == 4


def test_line_columns_give_what_the_functions_give(spark):
    def same(a, b):
        if isinstance(a, (list, tuple)):
            return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
        return a is b if a is None or b is None else abs(a - b) < 1e-9

    made = [[(0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (4.0, 3.0)], [(0.0, 0.0), (0.0, 10.0)], [(1.0, 1.0)], [(2.0, 5.0), (2.0, 5.0)], [], [(0.0, 0.0), (3.0, 4.0), (6.0, 0.0), (0.5, 0.25)]]
    data = [(i, a, b, x) for i, (a, b, x) in enumerate((a, b, x) for a in made for b in made for x in (-1.0, 0.0, 2.5, 4.0, 7.0, 99.0))]
    of = "array<struct<x:double,y:double>>"
    one, other, x = F.col("one"), F.col("other"), F.col("x")
    found = spark.createDataFrame(data, f"id int, one {of}, other {of}, x double").select(
        "id", lines.at_distance_udf(one, x).alias("at"), lines.project_udf(one, F.struct(x.alias("x"), F.lit(1.0).alias("y"))).alias("near"), lines.cut_out_udf(one, x - 3, x).alias("part"),
        lines.densify_udf(one, F.lit(2.0)).alias("dense"), lines.hausdorff_udf(one, other).alias("far"), lines.overlap_udf(one, other, x).alias("over"),
    )
    assert lines.project_udf.evalType == lines.overlap_udf.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    for r, (_, a, b, d) in zip(found.orderBy("id").collect(), data, strict=True):
        right = [lines.at_distance(a, d), lines.projected(a, (d, 1.0)), lines.cut_out(a, d - 3, d), lines.densified(a, 2.0), lines.hausdorff(a, b), lines.overlap(a, b, d)]
        assert same(list(r)[1:], right), (a, b, d, r, right)
    none = spark.sql(f"SELECT CAST(NULL AS {of}) AS one, CAST(1 AS DOUBLE) AS x")
    got = none.select(lines.at_distance_udf(one, x), lines.project_udf(one, F.struct(x.alias("x"), x.alias("y"))), lines.cut_out_udf(one, x, x), lines.densify_udf(one, x), lines.hausdorff_udf(one, one), lines.overlap_udf(one, one, x)).first()
    assert tuple(got) == (None, None, None, None, None, 0.0)


def test_coded_lines_keep_nulls_and_empty_lines(spark):
    of = "array<struct<lon:double,lat:double>>"
    made = [[(0.0, 0.0), (5.0, 0.1), (10.0, 0.0)], None, [], [(1.5, 2.5)], [(-3.0, 0.0), (3.0, 0.0), (9.0, 9.0), (3.0, -1.0)]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(made)], f"id int, line {of}").coalesce(1)
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("west", 0.0), ("south", -1.0), ("east", 4.0), ("north", 1.0))])
    packed_text = udfs.inflated(udfs.deflated(F.when(F.col("id") > 0, F.col("id").cast("string")).cast("binary"))).cast("string")
    found = rows.select("id", udfs.simplify_udf("line", F.lit(1.0)).alias("thin"), udfs.clip_udf("line", box).alias("parts"), udfs.polyline_points_udf(udfs.polyline_udf("line")).alias("back"), packed_text.alias("text"))
    assert "ArrowEvalPython" in plan(found) and "BatchEvalPython" not in plan(found) and all(x.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF for x in (udfs.simplify_udf, udfs.clip_udf, udfs.polyline_udf, udfs.polyline_points_udf, udfs.deflated))
    right = [(i, x and udfs.simplified(x, 1.0), x and udfs.clipped_line(x, (0.0, -1.0, 4.0, 1.0)), x, str(i) if i else None) for i, x in enumerate(made)]
    plain = lambda x: [plain(y) for y in x] if isinstance(x, (list, tuple)) else x
    assert plain(rows_in_order(found)) == plain(right)


def rows_in_order(df):
    return [tuple(r) for r in df.orderBy("id").collect()]


def test_neighbours_are_told_apart_once(spark):
    calls = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 3, 8), (1, 4, 7), (2, 1, 8), (2, 2, 9), (3, 1, 9), (4, 1, 7), (4, 2, None), (4, 3, 9)], "trip_id int, stop_sequence int, stop_id int")
    pairs = timetable.neighbours(calls)
    assert rows(pairs.select("stop_id", "neighbour")) == [(7, 8), (8, 7), (8, 9), (9, 8)]
    found = ranking.degree(pairs, distinct=True)
    assert plan(found).count("Exchange") == 3 and "least(" in plan(found)  # by trip, by pair, by stop
    assert rows(found) == [(7, 1), (8, 2), (9, 1)]


def test_routes_that_meet_are_not_moved_as_pairs(spark):
    table = lambda data, schema: spark.createDataFrame(data, schema)
    trips = table([(n, n % 4, "x") for n in range(12)], "trip_id int, route_id int, headsign string")
    calls = table([(n, 1, 100 + n % 4 // 2) for n in range(12)] + [(n, 2, 200 + n % 4 % 3) for n in range(12)], "trip_id int, stop_sequence int, stop_id int")
    stops = table([(s, 1.0, 2.0) for s in (100, 101, 200, 201, 202)], "stop_id int, lon double, lat double")
    found = reads.route_info(table([(r, 1) for r in range(5)], "route_id int, agency_id int"), table([(1, "a")], "agency_id int, agency_name string"), trips, calls, stops, table([], "alert_id int, route_id int"))
    assert "other" not in plan(found) and dict(found.dtypes)["n_connecting"] == "bigint"
    assert rows(found.select("route_id", "n_connecting")) == [(0, 2), (1, 1), (2, 1), (3, 2), (4, 0)]


def test_calls_lie_by_trip_and_move_once_more_by_stop(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid, told = (plan(QUERIES[name](spark, "/root/testdata/sf0.001")) for name in ("rt_overlay", "alert_overlay"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert laid.count("Exchange") == 4  # calls and trips, of all and of those with updates
    assert told.count("Exchange") == 6  # and calls and alerts by stop


def test_updates_laid_among_calls_match_as_joins_do(spark):
    made, days = random.Random(27), [date(2024, 1, 1), date(2024, 1, 2), None]
    pick = lambda *of: made.choice(of)
    calls = [(pick("a", "b", "c", None), pick(*days), pick(*range(1, 9), None), pick(*"STUV", None), n, n + 5) for n in range(400)]
    upd = [(pick("a", "b", "d", None), pick(*days), pick(*"STUW", None), pick(*range(3, 12), None, None), *(pick(None, made.randrange(99)) for _ in "ad"), pick(None, "CANCELED", "A"), pick(None, "SKIPPED"), pick(None, "1"), pick(None, "v", "w")) for _ in range(60)]

    def right(c):
        same = [u for u in upd if None not in c[:2] and u[:2] == c[:2]]
        most = lambda found: max((tuple((x is not None, x) if x is not None else (False,) for x in u) for u in found), default=None)
        told = lambda u: (u[5], u[4], u[7], u[8])
        best = most(told(u) for u in same if c[2] is not None and u[3] == c[2]) or most(told(u) for u in same if u[3] is None and c[3] is not None and u[2] == c[3])
        leaves, comes, status, platform = (x[-1] if x[0] else None for x in best) if best else (None,) * 4
        over = lambda i: max((u[i] for u in same if u[i] is not None), default=None)
        return (*c, None if leaves is None else comes, comes if leaves is None else leaves, over(6) == "CANCELED", status == "SKIPPED", platform, over(9))

    scheduled = spark.createDataFrame(calls, "trip_id string, date date, stop_sequence smallint, stop_id string, arrival long, departure long")
    updates = spark.createDataFrame(upd, "trip_id string, date date, stop_id string, stop_sequence int, rt_arrival long, rt_departure long, trip_status string, stop_status string, platform string, vehicle string")
    found = realtime.overlay(scheduled, updates)
    assert found.schema[:6] == scheduled.schema[:6]
    wanted = [right(c) for c in calls]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted)) and len({x[6:] for x in wanted}) > 10
    sequenced = updates.where("stop_sequence IS NOT NULL").withColumn("stop_sequence", F.coalesce("stop_sequence", F.lit(0)))  # never null, as the schema says
    upd = [u for u in upd if u[3] is not None]
    assert sorted(map(repr, map(tuple, realtime.overlay(scheduled, sequenced).collect()))) == sorted(repr(right(c)) for c in calls)
    late = scheduled.withColumn("stop_cancelled", F.col("stop_sequence") == 3).withColumn("departure", F.when(F.col("arrival") % 2 == 0, F.col("departure")))
    alerts = spark.createDataFrame([(1, "S", 100, 200), (1, "S", None, 20), (1, "T", 390, None), (2, "T", 0, None), (1, None, 0, None)], "effect int, stop_id string, start long, end long")
    off = lambda s, at: s == "S" and (100 <= at <= 200 or at <= 20) or s == "T" and at >= 390
    said = departures.cancelled_by_alert(late, alerts)
    assert sorted(said.columns) == sorted(late.columns)
    assert {r.arrival: r.stop_cancelled for r in said.collect()} == {c[4]: off(c[3], c[5] if c[4] % 2 == 0 else c[4]) or (None if c[2] is None else c[2] == 3) for c in calls}
