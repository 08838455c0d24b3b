import datetime as dt

import pytest
from pyspark.sql import functions as F

from tramline.functions import clock
from tramline.operators import calendar, departures, realtime, timetable
from tramline.operators.claims import claimed_intervals

D = dt.date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_service_days_and_exceptions(spark):
    cal = spark.createDataFrame([("M", 1, D(2024, 8, 1), D(2024, 8, 31)), ("N", None, D(2024, 8, 1), D(2024, 8, 2))], "service_id string, mask int, start_date date, end_date date")
    exc = spark.createDataFrame([("M", D(2024, 8, 26), 2), ("M", D(2024, 8, 27), 1), ("only", D(2024, 9, 1), 1), ("M", D(2024, 8, 28), 7)], "service_id string, date date, exception_type int")
    found = rows(calendar.service_days(cal, exc))
    assert ("M", D(2024, 8, 19)) in found and ("M", D(2024, 8, 26)) not in found
    assert ("M", D(2024, 8, 27)) in found and ("only", D(2024, 9, 1)) in found and len(found) == 5
    active = calendar.is_active(F.lit(D(2024, 8, 26)), F.lit(1), F.lit(D(2024, 8, 1)), F.lit(D(2024, 8, 31)), F.array().cast("array<date>"), F.array().cast("array<date>"))
    assert one(spark, active) is True
    assert rows(calendar.service_days(cal.limit(0), exc.limit(0))) == []


def test_optimal_calendar(spark):
    days = [D(2024, 7, 1), D(2024, 7, 2), D(2024, 7, 8), D(2024, 7, 22)]  # three of four Mondays, one of three Tuesdays
    got = calendar.optimal_calendar(spark.createDataFrame([("s", d) for d in days], "service_id string, date date")).first()
    assert (got.mask, got.n_added, got.n_removed) == (1, 1, 1)


@pytest.mark.parametrize(
    "observed, start, explicit, expected",
    [
        ("2026-08-01 12:00:00", 43_200, D(2026, 7, 31), D(2026, 7, 31)),
        ("2026-08-01 15:00:00", 50_400, None, D(2026, 8, 1)),
        ("2026-08-02 00:30:00", 82_800, None, D(2026, 8, 1)),
        ("2026-08-02 01:10:00", 90_000, None, D(2026, 8, 1)),
        ("2026-08-02 01:10:00", None, None, D(2026, 8, 2)),
    ],
)
def test_operation_date(spark, observed, start, explicit, expected):
    column = realtime.operation_date(F.lit(observed).cast("timestamp_ntz"), F.lit(start).cast("int"), F.lit(explicit).cast("date"))
    assert one(spark, column) == expected


@pytest.mark.parametrize(
    "updates, now, expected",
    [
        ([(100, 110, "1", None), (120, 130, "2", None)], 105, "1"),
        ([(100, 110, "1", None), (130, 140, "3", None), (120, 130, "2", None)], 115, "2"),
        ([(100, 110, "1", None), (120, 130, "2", None)], 200, "2"),
        ([(100, 110, "1", None), (120, 130, "2", "SKIPPED"), (140, 150, "3", None)], 115, "3"),
    ],
)
def test_closest_update(spark, updates, now, expected):
    df = spark.createDataFrame([("t", *u) for u in updates], "trip_id string, arrival int, departure int, stop_id string, status string")
    assert realtime.closest_update(df, F.lit(now)).first().stop_id == expected


def test_stop_matching(spark):
    sched = spark.createDataFrame([("t", "8833001"), ("t", "STOP123"), ("t", "P")], "trip_id string, stop_id string")
    rt = spark.createDataFrame([("t", "8833001_7"), ("t", "STOP999"), ("t", "child")], "trip_id string, rt_stop_id string")
    parents = spark.createDataFrame([("child", "P")], "stop_id string, parent_station string")
    assert rows(realtime.matched_stops(rt, sched, parents)) == [("t", "8833001_7", "8833001"), ("t", "child", "P")]


def test_midnight_is_noon_less_twelve_hours(spark):
    at = clock.service_midnight(F.lit(D(2024, 3, 10)), "America/Los_Angeles")
    assert one(spark, at) == int(dt.datetime(2024, 3, 10, 7, tzinfo=dt.timezone.utc).timestamp())
    gap = clock.local_epoch(F.lit("2024-03-10 02:30:00").cast("timestamp_ntz"), "America/Los_Angeles")
    assert one(spark, gap) is None


@pytest.mark.parametrize("text, seconds", [("25:10:05", 90_605), ("7:00:00", 25_200), ("07:60:00", None), ("x", None), (None, None)])
def test_clock(spark, text, seconds):
    assert one(spark, clock.seconds_of(F.lit(text).cast("string"))) == seconds


def test_twelve_hour_clock(spark):
    assert one(spark, clock.twelve_to_twentyfour(F.lit("From 7:05 pm to 12:30 a.m. and 12 pm"))) == "From 19:05 to 00:30 and 12:00"


def calls(spark, data):
    return spark.createDataFrame(data, "trip_id string, stop_sequence int, stop_id string, arrival int, departure int")


def trips(spark, ids):
    return spark.createDataFrame([(i, "r", "s", 0, "h", None) for i in ids], "trip_id string, route_id string, service_id string, direction_id int, headsign string, shape_id string")


def test_compression_and_back(spark):
    data = []
    for trip, base, middle in (("T1", 28_800, 600), ("T2", 32_400, 600), ("T3", 28_800, 720)):
        data += [(trip, 1, "a", base, base), (trip, 2, "b", base + middle, base + middle), (trip, 3, "c", base + 1200, base + 1200)]
    data += [("short", 1, "a", 5, 5), ("T1", 2, "b", 29_400, 29_400)]
    packed, itineraries, directions = timetable.compress(trips(spark, ["T1", "T2", "T3", "short", "none"]), calls(spark, data))
    assert sorted(r.start_time for r in packed.collect()) == [28_800, 28_800, 32_400]
    assert packed.select("pattern_id").distinct().count() == 2 and directions.count() == 1
    days = spark.createDataFrame([("s", D(2024, 1, 1), 1_000_000)], "service_id string, date date, midnight long")
    back = timetable.decompress(packed, itineraries, days).where("trip_id = 'T2'").orderBy("stop_sequence").collect()
    assert [r.arrival for r in back] == [1_032_400, 1_033_000, 1_033_600]


def test_interpolation(spark):
    df = spark.createDataFrame([("t", 1, 0), ("t", 2, None), ("t", 3, None), ("t", 4, 900), ("t", 5, None)], "trip_id string, stop_sequence int, time int")
    assert [r.time for r in timetable.interpolate(df).orderBy("stop_sequence").collect()] == [0, 450, 900, 900, None]
    assert [r.time for r in timetable.interpolate(df, step="n+1").orderBy("stop_sequence").collect()] == [0, 300, 600, 900, None]


def test_frequencies(spark):
    df = spark.createDataFrame([("t", 28_800, 30_600, 600), ("t", 29_400, 30_000, 600), ("u", 1, 2, 0)], "trip_id string, start_time int, end_time int, headway_secs int")
    assert rows(timetable.expand_frequencies(df)) == [("t", 28_800), ("t", 29_400), ("t", 30_000)]


def test_overlay_with_an_arrival_only_and_alerts(spark):
    sched = spark.createDataFrame([("t", D(2024, 1, 1), 1, "S", 900, 910), ("u", D(2024, 1, 1), 1, "S", 5, 6)], "trip_id string, date date, stop_sequence int, stop_id string, arrival long, departure long")
    upd = spark.createDataFrame([("t", D(2024, 1, 1), "S", None, 1000, None, None, None, None, "v")], "trip_id string, date date, stop_id string, stop_sequence int, rt_arrival long, rt_departure long, trip_status string, stop_status string, platform string, vehicle string")
    got = realtime.overlay(sched, upd).orderBy("trip_id").collect()
    assert (got[0].realtime_departure, got[0].realtime_arrival, got[0].vehicle) == (1000, None, "v")
    alerts = spark.createDataFrame([(1, "S", 800, None), (2, "S", 0, None)], "effect int, stop_id string, start long, end long")
    out = departures.cancelled_by_alert(realtime.overlay(sched, upd), alerts).orderBy("trip_id").collect()
    assert [(r.stop_cancelled, r.trip_cancelled) for r in out] == [(True, False), (False, False)]


def test_claiming(spark):
    today = D(2024, 6, 13)  # an interval that ended over five days before is dropped

    def claim(attempts):
        df = spark.createDataFrame([("f", *x) for x in attempts], "feed_id string, attempt_id long, start_date date, end_date date")
        return [tuple(r)[1:] for r in claimed_intervals(df, today).orderBy("attempt_id", ascending=False).collect()]

    assert claim([(2, D(2024, 6, 10), D(2024, 7, 1)), (1, D(2024, 5, 1), D(2024, 6, 30))]) == [(2, D(2024, 6, 10), D(2024, 7, 1), True), (1, D(2024, 5, 1), D(2024, 6, 9), False)]
    assert [r[0] for r in claim([(3, None, None), (2, D(2024, 1, 1), None)])] == [3]
    assert claim([]) == []


def test_detour(spark):
    plan = F.expr("array(named_struct('stop_id','a','arrival',0L,'departure',0L), named_struct('stop_id','b','arrival',100L,'departure',100L), named_struct('stop_id','c','arrival',200L,'departure',200L))")
    new = F.expr("array(named_struct('stop_id','x','travel_time',60L))")
    got = one(spark, realtime.detoured(plan, F.lit(1), F.lit(1), new, F.lit(30)))
    assert [(c.stop_id, c.arrival) for c in got] == [("a", 0), ("x", 60), ("c", 230)]
