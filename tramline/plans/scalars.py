"""Functions of one row over the benchmark tables, several in a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import clock, geo, lines, text, udfs
from tramline.operators import departures, filters
from tramline.plans import views
from tramline.plans.registry import Tables, query
from tramline.plans.views import STOPS_SQL


@query(r"""WITH e AS (SELECT event_id, date_trunc('second', ts) AS s, event_id * 7 % 24 AS h, event_id % 60 AS m FROM events)
SELECT event_id, 'Closed until ' || lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ' today' AS clock24, CAST(s AS DATE) AS day, CAST(epoch(s) AS BIGINT) - 7200 AS rfc,
CAST(epoch(timezone('America/Los_Angeles', s)) AS BIGINT) AS local, h * 3600 + m * 60 AS seconds FROM e""")
def clock_texts(t: Tables):
    """12-hour times in texts, compact dates, RFC 3339, local wall times, short clocks. [F3, F4, F5, F7, S2]"""
    h, m = F.col("event_id") * 7 % 24, F.col("event_id") % 60
    said = F.concat(F.lit("Closed until "), (h + 11) % 12 + 1, F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.when(h < 12, " am").otherwise(" p.m."), F.lit(" today"))
    short = F.concat(h, F.lit(":"), F.lpad(m.cast("string"), 2, "0"))
    return t.events.select(
        "event_id", clock.twelve_to_twentyfour(said).alias("clock24"), clock.compact_date(F.date_format("ts", "yyyyMMdd")).alias("day"),
        clock.epoch_of_rfc3339(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("rfc"),
        clock.local_epoch(F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"), "America/Los_Angeles").alias("local"),
        clock.seconds_of(clock.normalised_clock(short)).cast("long").alias("seconds"),
    )


@query(r"""SELECT p_partkey, '_' || p_partkey AS ident, 'r' || p_partkey AS route, trim(regexp_replace(regexp_replace('Gare ' || p_name || ' Station', '(?i)\b(station|gare|train|metro|railway|subway)\b', ' ', 'g'), '\s+', ' ', 'g')) AS short_name,
regexp_replace(p_name || '/' || p_brand || ' ', '[^A-Za-z0-9._-]+', '_', 'g') AS file, '&lt;' || p_name || '&gt; &amp; &quot;' || p_size || '&quot;' AS xml,
array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS title, round(p_size * 0.44704, 6) AS speed,
CASE WHEN p_size % 5 = 0 AND p_size % 8 < 2 THEN p_size % 8 END AS direction, md5(p_name) AS name_hash, sha256(p_name) AS name_sha FROM part""")
def text_repairs(t: Tables):
    """Ids without timestamps, route ids, short names, file names, escapes, titles, speeds, directions, hashes. [F9, F10, F12, F28, F30, F33, F34, P16]"""
    key, name = F.col("p_partkey"), F.col("p_name")
    header = 1_700_000_000 + F.col("p_size")
    direction = F.when(F.col("p_size") % 5 == 0, (F.col("p_size") % 8).cast("string")).otherwise("x")
    return t.part.select(
        "p_partkey", text.id_without_timestamp(F.concat(F.lit("-_"), header, key, F.lit("_")), header).alias("ident"), text.hyphen_trimmed(F.concat(F.lit("r"), key, F.lit("-1-2"))).alias("route"),
        text.shortened_name(F.concat(F.lit("Gare "), name, F.lit(" Station"))).alias("short_name"), text.file_safe(F.concat(name, F.lit("/"), "p_brand", F.lit(" "))).alias("file"),
        text.xml_escaped(F.concat(F.lit("<"), name, F.lit("> & \""), "p_size", F.lit("\""))).alias("xml"), text.title_case(F.upper(name)).alias("title"), F.round(text.metres_per_second(F.col("p_size").cast("string")), 6).alias("speed"),
        filters.repaired_direction(direction).cast("long").alias("direction"), F.md5(name).alias("name_hash"), F.sha2(name, 256).alias("name_sha"),
    )


@query("""WITH c AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS n FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '0A0B0C' ELSE printf('%06X', n) END AS colour, CASE WHEN ((n >> 16) & 255) * 299 + ((n >> 8) & 255) * 587 + (n & 255) * 114 >= 128000 THEN '000000' ELSE 'FFFFFF' END AS contrast,
lower('ff' || printf('%02X', n & 255) || printf('%02X', (n >> 8) & 255) || printf('%02X', (n >> 16) & 255)) AS kml FROM c""")
def colours(t: Tables):
    """White and broken colours to the default, contrast, KML order. [F27, P16]"""
    n = F.lpad(F.hex(F.col("p_partkey") * 7919 % 16_777_216), 6, "0")
    raw = F.when(F.col("p_partkey") % 20 == 0, "ffffff").when(F.col("p_partkey") % 10 == 0, "none").otherwise(F.concat(F.lit("#"), F.lower(n)))
    return t.part.select("p_partkey", text.hex_colour(raw, "0A0B0C").alias("colour"), text.contrast_colour(n).alias("contrast"), text.kml_colour(n).alias("kml"))


@query("""WITH x AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_name || ' ' || p_brand), ' ') AS w, p_brand, p_type, p_size FROM part)
SELECT p_partkey, CASE WHEN p_brand = p_type THEN NULL ELSE '0,1,0' END AS marks, 1.0 AS overlap, CAST(p_partkey % 100000 AS INTEGER) AS station,
CAST(CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE -1 END AS INTEGER) AS kind, p_size % 3 = 0 OR p_size % 7 = 1 AS enabled FROM x WHERE p_partkey % 100000 > 0""")
def codes_and_names(t: Tables):
    """Headsign lists, token overlap, Swiss station numbers, enum names, regional roll-out. [F11, F16, F35, P18, P19]"""
    key, size = F.col("p_partkey") % 100_000, F.col("p_size")
    listed = text.headsign_index(F.array("p_brand", "p_type", "p_brand"))
    written = F.when(key % 3 == 0, F.concat(F.lit("ch:1:sloid:"), key)).when(key % 3 == 1, F.concat(F.lit("85"), F.lpad(key.cast("string"), 5, "0"), F.lit(":0:1"))).otherwise(key.cast("string"))
    named = F.when(size % 4 == 0, "Tram").when(size % 4 == 1, "rail").when(size % 4 == 2, "BUS").otherwise("zeppelin")
    places = filters.rolled_out(F.array(F.when(size % 3 == 0, "ca").otherwise("fr")), F.array(F.lit("US-TX"), F.when(size % 7 == 1, "US-Ny").otherwise(F.lit(None))))
    return t.part.where(key > 0).select(
        "p_partkey", F.array_join(listed["index"], ",").alias("marks"), text.token_overlap(F.col("p_name"), F.concat_ws(" ", "p_brand", F.upper("p_name"))).alias("overlap"), text.station_number(written).alias("station"),
        filters.enum_code(named, {"TRAM": 0, "RAIL": 2, "BUS": 3}, -1).alias("kind"), places.alias("enabled"),
    )


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'fast' || s_suppkey WHEN 1 THEN 'city' || s_suppkey WHEN 2 THEN 'Metro_Line_' || s_suppkey WHEN 3 THEN 'Transit' ELSE 'transit' || s_suppkey END AS unified FROM supplier""")
def unified_agencies(t: Tables):
    """[D35]"""
    key, kind = F.col("s_suppkey"), F.col("s_suppkey") % 5
    name = F.when(kind == 2, F.concat(F.lit("Metro Line "), key)).when(kind == 4, " TRANSIT ").otherwise("Transit")
    url = F.when(kind == 0, F.concat(F.lit("https://www.fast"), key, F.lit(".co.uk/x"))).when(kind == 1, F.concat(F.lit("city"), key, F.lit(".org"))).when(kind == 3, "http://10.0.0.1/").when(kind == 4, F.concat(F.lit("http://m.transit"), key, F.lit(".example./")))
    return t.supplier.select("s_suppkey", text.unified_agency_id(name, url.try_cast("string"), ["transit", "public transport"]).alias("unified"))


@query(f"""WITH s AS ({STOPS_SQL}), m AS (SELECT *, 6371008.8 AS r, 4096 AS k FROM s)
SELECT stop_id, round(radians(lon + 117.5) * cos(radians(34.5)) * r, 3) AS east, round(radians(lat - 34.5) * r, 3) AS north, round(lon, 6) AS lon_back, round(lat, 6) AS lat_back,
round(radians(lon) * 6378137.0, 2) AS web_x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 2) AS web_y, round(x / k * 360 - 180, 8) AS west, round((x + 1) / k * 360 - 180, 8) AS east_edge,
round(degrees(atan(sinh(pi() * (1 - 2 * y / k)))), 8) AS north_edge, lon BETWEEN -117.8 AND -117.4 AND lat BETWEEN 34.2 AND 34.6 AS inside, round(lon, 4) AS wire FROM
(SELECT *, floor((lon + 180) / 360 * k) AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * k) AS y FROM m)""")
def geo_planes(t: Tables):
    """Tangent plane and back, Web-Mercator, tile bounds, boxes, rounding. [F19, F24, F25, F36, P4, D52]"""
    lon, lat = F.col("lon"), F.col("lat")
    east, north = geo.local_plane(lon, lat, -117.5, 34.5)
    back = geo.from_local_plane(east, north, -117.5, 34.5)
    web = geo.web_mercator(lon, lat)
    box = geo.tile_bounds(geo.tile_x(lon, 12), geo.tile_y(lat, 12), 12)
    return views.stops(t).select(
        "stop_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"), F.round(back[0], 6).alias("lon_back"), F.round(back[1], 6).alias("lat_back"), F.round(web[0], 2).alias("web_x"), F.round(web[1], 2).alias("web_y"),
        F.round(box["west"], 8).alias("west"), F.round(box["east"], 8).alias("east_edge"), F.round(box["north"], 8).alias("north_edge"), geo.in_box(lon, lat, -117.8, 34.2, -117.4, 34.6).alias("inside"), geo.rounded(lon, 4).alias("wire"),
    )


def _spread(t: Tables):
    """The parts in as many tasks as there are cores: a table of one file is read by one."""
    return t.part.repartition(t.spark.sparkContext.defaultParallelism)


_CORNER_SQL = "SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 40 + 1 AS DOUBLE) AS b, CAST(p_partkey % 7 AS DOUBLE) AS f FROM part"


@query(f"""WITH c AS ({_CORNER_SQL}) SELECT p_partkey, a + b AS metres, CASE WHEN (a + b) * f / 7 <= a THEN round((a + b) * f / 7, 6) ELSE a END AS at_x, CASE WHEN (a + b) * f / 7 <= a THEN 0.0 ELSE round((a + b) * f / 7 - a, 6) END AS at_y,
2.0 AS far, a + b / 2 AS along, CAST(ceil(a / 3) + ceil(b / 3) + 1 AS BIGINT) AS n_dense, round(b / 2, 6) AS part_metres, f AS hausdorff, CASE WHEN f <= 3 THEN 1.0 ELSE 0.0 END AS overlap FROM c""")
def line_algebra(t: Tables):
    """Length, point at a fraction, projection, thinning out and cutting of a line with one corner; distance and overlap of parallels. [F21]"""
    a, b, f = F.col("p_size").cast("double"), (F.col("p_partkey") % 40 + 1).cast("double"), (F.col("p_partkey") % 7).cast("double")
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "cast") else y.alias("y"))
    row = _spread(t).select("p_partkey", a.alias("a"), b.alias("b"), f.alias("f")).withColumn("line", F.array(point(0.0, 0.0), point(F.col("a"), 0.0), point(F.col("a"), F.col("b"))))
    row = row.withColumn("straight", F.array(point(0.0, 0.0), point(F.col("a"), 0.0))).withColumn("beside", F.array(point(0.0, F.col("f")), point(F.col("a"), F.col("f"))))
    straight, beside = F.col("straight"), F.col("beside")
    total = F.col("a") + F.col("b")
    steps = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    made = row.select(
        "p_partkey", F.aggregate(steps, F.lit(0.0), lambda s, x: s + x).alias("metres"), lines.at_distance_udf("line", total * F.col("f") / 7).alias("at"),
        lines.project_udf("line", point(F.col("a") + 2, F.col("b") / 2)).alias("near"), F.size(lines.densify_udf("line", F.lit(3.0))).cast("long").alias("n_dense"),
        lines.cut_out_udf("line", F.col("a") + F.col("b") / 2, total).alias("part"), lines.hausdorff_udf(straight, beside).alias("hausdorff"), lines.overlap_udf(straight, beside, F.lit(3.0)).alias("overlap"),
    )
    first, last = F.get("part", F.lit(0)), F.try_element_at("part", F.lit(-1))
    return made.select("p_partkey", "metres", F.round("at.x", 6).alias("at_x"), F.round("at.y", 6).alias("at_y"), F.round("near.metres", 6).alias("far"), F.col("near.along").alias("along"), "n_dense", F.round(last["y"] - first["y"], 6).alias("part_metres"), "hausdorff", "overlap")


@query(f"""WITH c AS ({_CORNER_SQL}) SELECT p_partkey, CAST(CASE WHEN f > 3 THEN 3 ELSE 2 END AS INTEGER) AS n_kept, least(a, 20.0) AS clipped, a <= 50 AS crosses, round(a / 100, 5) AS lon, round(b / 100, 5) AS lat, md5('b' || p_partkey) AS unpacked FROM c""")
def line_coding(t: Tables):
    """Simplified and clipped lines, encoded and read back; packed bytes. [F22, F23, F26, F29]"""
    a, b, f = F.col("p_size").cast("double"), (F.col("p_partkey") % 40 + 1).cast("double"), (F.col("p_partkey") % 7).cast("double")
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    zero = F.lit(0.0)
    kept = udfs.simplify_udf(F.array(point(zero, zero), point(a, f), point(2 * a, zero)), F.lit(3.0))
    inside = udfs.clip_udf(F.array(point(-a, zero), point(zero, zero), point(a, zero), point(2 * a + 100, zero)), F.struct(zero.alias("west"), F.lit(-1.0).alias("south"), F.lit(20.0).alias("east"), F.lit(1.0).alias("north")))
    coded = udfs.polyline_points_udf(udfs.polyline_udf(F.array(point(zero, zero), point(a / 100, b / 100))))
    packed = udfs.inflated(udfs.deflated(F.concat(F.lit("b"), "p_partkey").cast("binary"))).cast("string")
    made = _spread(t).select("p_partkey", F.size(kept).alias("n_kept"), a.alias("a"), inside.alias("inside"), coded.alias("coded"), F.md5(packed).alias("unpacked"))
    one = F.get("inside", F.lit(0))
    return made.select("p_partkey", "n_kept", F.least(F.col("a"), F.try_element_at(one, F.lit(-1))["lon"]).alias("clipped"), (F.size("inside") == 1).alias("crosses"), F.round(F.get("coded", F.lit(1))["lon"], 5).alias("lon"), F.round(F.get("coded", F.lit(1))["lat"], 5).alias("lat"), "unpacked")


@query(f"""WITH s AS (SELECT stop_id, stop_id % 4 AS kind, stop_id % 2 = 0 AS merged, 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(34.4 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(34.4)) * power(sin(radians(-117.6 - lon) / 2), 2)))) AS m FROM ({STOPS_SQL})),
r AS (SELECT *, count(*) OVER () AS n, count(*) FILTER (merged) OVER () AS k FROM s WHERE m <= 5000)
SELECT stop_id FROM r WHERE NOT (kind = 3 AND (n > 100 AND m > 4000 OR n > 300 AND m > 2500 OR n > 500 AND m > 1500 OR n > 800 AND m > 1000 OR k > 50 AND m > 2000)) AND NOT (k > 100 AND m > 2500)""")
def density_cut(t: Tables):
    """Stops near a point, less far where there are many. [P8]"""
    here = views.stops(t).withColumn("metres", geo.haversine(F.lit(-117.6), F.lit(34.4), F.col("lon"), F.col("lat"))).where("metres <= 5000")
    sizes = here.agg(F.count("*").alias("n"), F.count_if(F.col("stop_id") % 2 == 0).alias("k"))
    kept = here.crossJoin(F.broadcast(sizes))  # one row
    return kept.where(departures.near_enough(F.col("metres"), F.col("stop_id") % 4, F.col("n"), F.col("k"))).select("stop_id")
