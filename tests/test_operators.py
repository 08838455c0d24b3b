import itertools
import random

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo, text, udfs
from tramline.operators import alerts, components, filters, history, joins, ranking, search, spatial, upsert


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_alert_merge(spark):
    schema = "alert_id string, text string, periods array<struct<start:long,end:long>>, entities array<string>"
    data = [("A", "same", [(100, 200)], ["R1"]), ("B", "same", [(300, 400)], ["R1"]), ("C", "same", [(300, 400)], ["R2"]), ("D", "same", [(500, 600)], ["R3"])]
    got = {r.alert_id: r for r in components.merged_alerts(spark.createDataFrame(data, schema)).collect()}
    assert set(got) == {"A", "D"} and len(got["A"].periods) == 2 and got["A"].entities == ["R1", "R2"]
    data = [("A", "x", [(100, 200), (300, 400)], ["R1"]), ("B", "x", [(300, 400), (100, 200)], ["R2"])]
    assert components.merged_alerts(spark.createDataFrame(data, schema)).first().entities == ["R1", "R2"]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "u long, v long")
    got = dict(rows(components.components(edges)))
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == 100
    assert rows(components.components(edges.limit(0))) == []


def test_walk_costs(spark):
    edges = spark.createDataFrame([("A", "B", 100.0), ("B", "C", 200.0), ("C", "D", 150.0), ("A", "C", 400.0)], "a string, b string, cost double")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    start = spark.createDataFrame([("s", "A"), ("t", "D")], "source string, node string")
    got = {(s, n): c for s, n, c in rows(components.shortest_costs(both, start, 1000))}
    assert got["s", "D"] == got["t", "A"] == 450


def test_earliest_arrivals(spark):
    calls = spark.createDataFrame([("x", 1, "a", 0, 100), ("x", 2, "b", 200, 210), ("y", 1, "b2", 0, 260), ("y", 2, "c", 300, 300), ("z", 1, "a", 0, 90), ("z", 2, "c", 900, 900), ("late", 1, "b2", 0, 205), ("late", 2, "c", 220, 220)], "trip_id string, stop_sequence int, stop_id string, arrival int, departure int")
    walk = spark.createDataFrame([("b", "b2", 30)], "from_stop string, to_stop string, seconds int")
    got = {r.stop_id: (r.arrival, r.rides) for r in components.earliest_arrivals(calls, walk, "a", 80).collect()}
    assert got["b"] == (200, 1) and got["b2"] == (230, 1) and got["c"] == (300, 2)


def test_radius_join_finds_all_pairs(spark):
    rng = random.Random(1)
    points = [(i, 8 + rng.random() / 10, 50 + rng.random() / 10) for i in range(150)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    other = df.select(F.col("id").alias("r_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    got = {(a, b) for a, b in rows(spatial.radius_join(df, other, 800).select("id", "r_id"))}
    near = df.crossJoin(other).where(geo.haversine(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat")) <= 800).select("id", "r_id")
    assert got == set(rows(near)) and len(got) > 150


def test_suppression_is_the_greedy_one(spark):
    rng = random.Random(2)
    points = [(i, rng.random(), 47 + rng.random(), float(rng.randrange(30))) for i in range(120)]
    df = spark.createDataFrame(points, "id int, lon double, lat double, score double")
    pairs = {(r[0], r[1]) for r in df.crossJoin(df.select(F.col("id").alias("b"), F.col("lon").alias("x"), F.col("lat").alias("y"))).where(geo.haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) <= 15_000).select("id", "b").collect()}
    placed = []
    for i, _, _, _ in sorted(points, key=lambda p: (-p[3], p[0])):
        if not any((i, j) in pairs for j in placed):
            placed.append(i)
    assert [r[0] for r in rows(spatial.suppressed(df, 15).select("id"))] == sorted(placed)


def test_tiers(spark):
    df = spark.createDataFrame([(i, False, float(i)) for i in range(1, 11)], "id int, is_rail boolean, score double")
    got = dict(rows(ranking.tiers(df).select("id", "tier")))
    assert got == {**{i: 9 for i in range(1, 6)}, **{i: 8 for i in range(6, 10)}, 10: 7}
    flat = spark.createDataFrame([(i, 1.0) for i in range(3)], "id int, a double")
    assert [r.z_a for r in ranking.z_scores(flat, ["a"]).collect()] == [0, 0, 0]


def test_hull(spark):
    points = [(k, float(x), float(y)) for k in "ab" for x, y in itertools.product(range(4), range(4))] + [("a", None, None)]
    got = {r.k: {(p.lon, p.lat) for p in r.hull} for r in spatial.hulls(spark.createDataFrame(points, "k string, lon double, lat double"), "k").collect()}
    assert got == {k: {(0, 0), (3, 0), (0, 3), (3, 3)} for k in "ab"}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ts int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, ts int")
    assert rows(upsert.upserted(old, new, ["k"], ["ts"])) == [(1, "a", 1), (2, "d", 2), (3, "e", 1)]
    assert len(rows(upsert.inserted(old, new, ["k"]))) == 3
    assert rows(upsert.updated(old, spark.createDataFrame([(1, "z"), (2, None)], "k int, v string"), ["k"], ["v"])) == [(1, "z", 1), (2, "b", 1)]


def test_ip_ranges(spark):
    asked = spark.createDataFrame([("10.0.1.7",), ("10.9.0.0",), ("no",), (None,), ("1.2.3.400",)], "ip string")
    ranges = spark.createDataFrame([("10.0.0.0", "10.1.255.255", "X")], "ip_range_start string, ip_range_end string, city string")
    assert [r.city for r in joins.located_ips(asked, ranges).collect()] == ["X"]


def test_texts(spark):
    assert one(spark, text.html_decoded(F.lit("a &amp;lt; b&nbsp;&quot;c&quot;"))) == 'a &lt; b "c"'
    assert one(spark, text.hex_colour(F.lit("#ffffff"), "0A0A0A")) == "0A0A0A"
    assert one(spark, text.kml_colour(F.lit("112233"))) == "ff332211"
    assert one(spark, text.contrast_colour(F.lit("FFFF00"))) == "000000"
    assert one(spark, text.domain_label(F.lit("https://www.example.org/x"))) == "example"
    assert one(spark, text.host_of(F.lit("no url"))) is None
    assert one(spark, text.language_of(F.lit("Der Zug ist und die Bahn"))) == "de"
    assert one(spark, text.id_without_timestamp(F.lit("-170-abc_"), F.lit(170))) == "-abc"
    assert one(spark, text.station_number(F.lit("ch:1:sloid:7000"))) == 7000
    assert one(spark, alerts.keyword_code(F.lit("Big DELAY on strike day"), alerts.CAUSES, 1)) == 4
    assert one(spark, search.station_tokens(F.lit("Gare Bern Hbf")))[-1] == "hauptbahnhof"


def test_jaro_winkler():
    import duckdb

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(2))
        assert udfs.jaro_winkler(a, b) == pytest.approx(duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0])


def test_lines():
    points = [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    assert udfs.polyline(points) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert udfs.polyline_points(udfs.polyline(points)) == points
    assert udfs.simplified([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], 0.1) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    assert udfs.clipped((-1, 0.5), (2, 0.5), (0, 0, 1, 1)) == ((0, 0.5), (1, 0.5))
    assert udfs.clipped((-1, 5), (2, 5), (0, 0, 1, 1)) is None


def test_history(spark):
    seen = spark.createDataFrame([("c", "v1", "t", "r1", "2024-01-01"), ("c", "v2", "t", "r2", "2024-01-02"), ("d", "v3", "t", "r9", "2024-01-02")], "chateau string, vehicle_label string, trip_id string, route_id string, operation_date string")
    routes = spark.createDataFrame([("c", "r1", "f1", "a1"), ("c", "r2", "f2", None)], "chateau string, route_id string, feed_id string, agency_id string")
    agencies = spark.createDataFrame([("c", "f1", "a1"), ("c", "f2", "a2"), ("d", "f3", "a3")], "chateau string, feed_id string, agency_id string")
    built = history.vehicle_history(seen, routes, agencies)
    assert {r.vehicle_label: r.agency_id for r in built.collect()} == {"v1": "a1", "v2": "a2", "v3": "a3"}
    assert [r.vehicle_label for r in history.looked_up(built, ["a1", "a2"], "2024-01-01").collect()] == ["v2", "v1"]


def test_closures(spark):
    feed = {
        "routes": spark.createDataFrame([("r1", 2, "a"), ("r2", 3, "b")], "route_id string, route_type int, agency_id string"),
        "trips": spark.createDataFrame([("t1", "r1", "h1"), ("t2", "r2", None)], "trip_id string, route_id string, shape_id string"),
        "stop_times": spark.createDataFrame([("t1", "s1"), ("t2", "s2"), ("gone", "s1")], "trip_id string, stop_id string"),
        "stops": spark.createDataFrame([("s1", "p"), ("p", "g"), ("g", None), ("s2", None)], "stop_id string, parent_station string"),
        "shapes": spark.createDataFrame([("h1",), ("h2",)], "shape_id string"),
    }
    kept = filters.only_route_types(feed, [2])
    assert [r[0] for r in rows(kept["stops"].select("stop_id"))] == ["g", "p", "s1"] and rows(kept["shapes"]) == [("h1",)]
    assert [r[0] for r in rows(filters.without_agencies(feed, ["a"])["trips"].select("trip_id"))] == ["t2"]
    assert one(spark, filters.rolled_out(F.array(F.lit("US")), F.array(F.lit("us-NY")))) is True
