import time

import pytest
from pyspark.sql import functions as F

from tramline.streaming import operators as S


def wait(query, batches):
    """Until so many batches had rows. Operators with a processing-time limit never come to rest, so no processAllAvailable."""
    end = time.time() + 60
    while sum(p["numInputRows"] > 0 for p in query.recentProgress) < batches:
        if not query.isActive or time.time() > end:
            raise AssertionError(query.exception() or "the stream stands still")
        time.sleep(0.2)


@pytest.fixture
def run(spark, tmp_path):
    """Feed batches of rows through a streaming operator, one after the other, and return what each one gave."""

    def go(schema, batches, build, mode="append", rests=False):
        source, out = tmp_path / "in", []
        source.mkdir()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = build(stream).writeStream.trigger(processingTime="300 milliseconds").outputMode(mode).foreachBatch(lambda df, i: out.append(sorted(map(tuple, df.collect()), key=repr))).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            for n, rows in enumerate(batches, 1):
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
                query.processAllAvailable() if rests else wait(query, n)
        finally:
            query.stop()
        return [x for x in out if x]

    return go


def test_changed_only(run):
    schema = "feed_id string, ts long, body string"
    got = run(schema, [[("f", 1, "a"), ("f", 2, "a")], [("f", 3, "a")], [("f", 4, "b"), ("g", 1, "b")]], lambda s: S.changed_only(s, ["feed_id"], "body", "ts"))
    assert got == [[("f", 1, "a")], [("f", 4, "b"), ("g", 1, "b")]]


def test_header_gate(run):
    schema = "feed_id string, fetched_ms long, kind string, header_ts long"
    batches = [[("f", 1, "trips", 10), ("f", 1, "alerts", 5)], [("f", 2, "trips", 10), ("f", 2, "alerts", 5)], [("f", 3, "trips", 9), ("f", 3, "alerts", 5)], [("f", 4, "trips", None)]]
    got = run(schema, batches, lambda s: S.header_gate(s))
    assert [sorted({r[1] for r in b}) for b in got] == [[1], [3], [4]] and len(got[1]) == 2


def test_header_gate_knows_kinds_that_are_numbers(run):
    schema = "feed_id long, fetched_ms long, kind int, header_ts long"
    batches = [[(1, 2, 2, 6), (1, 1, 1, 10), (1, 1, 2, 5), (1, 2, 1, 10), (1, 3, 1, 10), (1, 3, 2, 6)], [(1, 4, 1, 10), (1, 4, 2, 6), (1, 5, 1, 0), (1, 5, 2, 6)]]
    got = run(schema, batches, lambda s: S.header_gate(s))
    assert got == [[(1, 1, 1, 10), (1, 1, 2, 5), (1, 2, 1, 10), (1, 2, 2, 6)], [(1, 5, 1, 0), (1, 5, 2, 6)]]


def test_latest(run):
    got = run("k string, ts long, v string", [[("a", 1, "x"), ("a", 3, "z")], [("a", 2, "y")]], lambda s: S.latest(s, ["k"], "ts"), "update")
    assert got[-1] == [("a", 3, "z")]


def test_recent_positions(run):
    schema = "vehicle_id string, timestamp long, lon double, lat double"
    got = run(schema, [[("v", 1, 0.0, 0.0), ("v", 2, 1.0, 0.0)], [("v", 3, 2.0, 0.0)], [("v", 4, 1.0, 0.0)]], lambda s: S.recent_positions(s), "update")
    assert [len(b[0][1]) for b in got] == [2, 3, 1]


def test_windows_drop_late_rows(run):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    got = run("ts timestamp, k string", [[(at(1), "a"), (at(2), "a")], [(at(100), "a")], [(at(3), "a")], [(at(300), "a")]], lambda s: S.windowed(s, "ts", "10 minutes"), rests=True)
    assert [r[2] for b in got for r in b] == [2, 1]


def test_pushed_tiles(spark):
    tiles = spark.createDataFrame([("rail", x, 0, f"b{x}", 7) for x in range(6)], "category string, x int, y int, body string, feed_ts long")
    box = lambda w, e: (w, 0, e, 0)
    schema = "subscriber string, category string, box struct<w:int,n:int,e:int,s:int>, last_box struct<w:int,n:int,e:int,s:int>, last_ts long"
    asked = [("new", "rail", box(0, 1), None, None), ("moved", "rail", box(1, 4), box(0, 2), 7), ("stale", "rail", box(0, 2), box(0, 2), 6), ("same", "rail", box(0, 2), box(0, 2), 7)]
    got = S.pushed(tiles, spark.createDataFrame(asked, schema)).groupBy("subscriber").agg(F.sort_array(F.collect_list("x")).alias("x")).collect()
    assert {r.subscriber: r.x for r in got} == {"new": [0, 1], "moved": [3, 4], "stale": [0, 1, 2]}
