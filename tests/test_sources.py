import json
import zipfile

from pyspark.sql import functions as F

from tramline.sources import feeds, gtfs, sinks


def test_feed_from_a_nested_archive(spark, tmp_path):
    inner, outer = tmp_path / "inner.zip", tmp_path / "outer.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("sub/stop_times.txt", "trip_id,stop_sequence,stop_id,arrival_time,departure_time\nb,2,s2,25:00,25:00:30\na,1,s1,8:00:00,\nb,1,s1,08:00:00,bad\n")
        z.writestr("sub/calendar.txt", "﻿service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nx,1,0,0,0,0,0,1,20240101,2024\n")
        z.writestr("../../shapes.txt", "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nh,1.5,2.5,2\nh,1,2,1\n")
    with zipfile.ZipFile(outer, "w") as z:
        z.write(inner, "deep/inner.zip")
    folder = gtfs.unpack(str(outer), str(tmp_path / "feed"))
    feed = gtfs.read_feed(spark, folder)
    calls = {r.trip_id: r.calls for r in gtfs.calls_by_trip(feed["stop_times"]).collect()}
    assert [(c.stop_id, c.arrival, c.departure) for c in calls["b"]] == [("s1", 28_800, None), ("s2", 90_000, 90_030)]
    day = feed["calendar"].first()
    assert (day.mask, str(day.start_date), day.end_date) == (65, "2024-01-01", None)
    assert [(p.lon, p.lat) for p in gtfs.lines(feed["shapes"]).first().points] == [(2, 1), (2.5, 1.5)]
    assert feed["agency"].count() == 0
    assert gtfs.folder_hash(spark, folder) == gtfs.folder_hash(spark, folder)


def test_situations(spark):
    xml = "<S><ns:PtSituationElement><SituationNumber>1</SituationNumber><Summary xml:lang='fr'> Retard </Summary><StartTime>2024-01-01T00:00:00Z</StartTime><LineRef>A</LineRef><LineRef>B</LineRef></ns:PtSituationElement></S>"
    got = feeds.situations(spark.createDataFrame([(xml,), (None,)], "body string")).collect()
    assert [(r.alert_id, r.header, r.start, r.routes, r.end) for r in got] == [("1", "Retard", 1_704_067_200, ["A", "B"], None)]


def test_registry_and_areas(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"feeds": [{"id": "f2", "spec": "gtfs", "urls": {"static_current": "u"}}, {"id": "f1", "spec": "gtfs", "urls": {"static_current": "u"}}, {"id": "f3", "spec": "gtfs-rt", "urls": {}}]}))
    found = feeds.without_overlaps(feeds.registry(spark, str(tmp_path / "r.json")), [])
    assert sorted(r.feed_id for r in found.collect()) == ["f1", "f3"]
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    (tmp_path / "a.json").write_text(json.dumps({"features": [{"properties": {"id": "A"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"id": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}))
    got = feeds.areas(spark, str(tmp_path / "a.json"), "id").collect()
    assert sorted(r.area_id for r in got) == ["A", "B", "B"] and all(len(r.rings[0]) == 5 for r in got)


def test_osm(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, {"railway": "station", "name": "N", "name:de": "D"}), (2, 0.0, 0.0, {"shop": "x"})], "osm_id long, lon double, lat double, tags map<string,string>")
    assert [(r.osm_id, r.mode_type, r.station_type, r.names) for r in feeds.osm_stations(nodes).collect()] == [(1, "rail", "station", {"name:de": "D"})]
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 9])], "way_id long, node_ids array<long>")
    assert sorted((r.way_id, tuple(r.node_ids)) for r in feeds.rail_segments(ways).collect()) == [(1, (1, 2)), (1, (2, 3)), (2, (2, 9))]
    roads = spark.createDataFrame([(1, [1, 2], {"highway": "footway", "maxspeed": "30 mph"})], "way_id long, node_ids array<long>, tags map<string,string>")
    spots = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.001)], "node_id long, lon double, lat double")
    edge = feeds.street_edges(roads, spots).first()
    assert edge.foot and not edge.car and edge.speed_kmh == 48 and 111 < edge.metres < 112


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1), ("c2", 2)], "chateau string, v int")
    sinks.append(df, str(tmp_path / "t"))
    sinks.replace_partitions(df.where("v = 2").withColumn("v", F.lit(5)), str(tmp_path / "t"), ["chateau"])
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 5]
    sinks.snapshot(df, str(tmp_path / "s"), 1)
    sinks.snapshot(df.limit(1), str(tmp_path / "s"), 2)
    assert sinks.read_snapshot(spark, str(tmp_path / "s")).count() == 1
    line = F.expr("array(named_struct('lon', 1.5D, 'lat', 2D))")
    got = spark.range(1).select(sinks.geojson_feature(line, F.struct(F.lit("a<b").alias("name"))).alias("g"), sinks.gpx_track(line, F.lit("a<b")).alias("x"), sinks.kml_placemark(line, F.lit("n"), F.lit("112233")).alias("k")).first()
    assert json.loads(got.g)["geometry"]["coordinates"] == [[1.5, 2.0]] and "a&lt;b" in got.x and "ff332211" in got.k
