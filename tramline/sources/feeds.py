"""Other inputs: registries, fleets, address ranges, areas, OpenStreetMap extracts, realtime messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.text import tag_block
from tramline.schemas import IP_RANGES, RAW_MESSAGES, struct


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of a JSON registry: feed_id, spec, url. [S12]"""
    schema = "feeds array<struct<id:string,spec:string,urls:struct<static_current:string,realtime_vehicle_positions:string,realtime_trip_updates:string,realtime_alerts:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.select(F.explode("feeds").alias("f")).select(F.col("f.id").alias("feed_id"), "f.spec", F.col("f.urls.static_current").alias("url"), F.col("f.urls").alias("urls"))


def without_overlaps(feeds: DataFrame, unwanted: list[str]) -> DataFrame:
    """Feeds that no other one covers: unwanted ids out, and of feeds with the same url the least id. [S12]"""
    kept = feeds.where(~F.col("feed_id").isin(unwanted))
    with_url = kept.where("url IS NOT NULL").groupBy("url").agg(F.min("feed_id").alias("feed_id")).select("feed_id")
    return kept.where("url IS NULL").unionByName(kept.where("url IS NOT NULL").join(with_url, "feed_id", "left_semi"))


def ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped or plain CSV without a header. [S13]"""
    return spark.read.schema(IP_RANGES).csv(path)


def fleet(spark: SparkSession, path: str) -> DataFrame:
    """Vehicle ranges of a tree of JSON files. [S14]"""
    schema = "chateau string, roster array<struct<starting_range:int,ending_range:int,manufacturer:string,model:string,years:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).select("chateau", F.col("_metadata.file_path").alias("file_path"), F.explode("roster").alias("r"))
    return rows.select("chateau", "file_path", "r.*")


def areas(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """area_id and ``rings`` (the outer one and its holes) of each polygon of a GeoJSON collection. [S15]"""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    many = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")).otherwise(F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>")))
    polygon = rows.select(F.try_element_at("f.properties", F.lit(id_property)).alias("area_id"), F.explode(many).alias("polygon"))
    return polygon.select("area_id", F.transform("polygon", lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))).alias("rings"))


def situations(xml: DataFrame, body: str = "body") -> DataFrame:
    """SIRI situations: id, summary, description, start, end, lines. [S10]"""
    each = xml.select(F.explode(tag_block(F.col(body), "PtSituationElement")).alias("x"))
    one = lambda tag: F.trim(F.try_element_at(tag_block(F.col("x"), tag), F.lit(1)))
    at = lambda tag: F.unix_timestamp(F.try_to_timestamp(one(tag)))
    return each.select(one("SituationNumber").alias("alert_id"), one("Summary").alias("header"), one("Description").alias("description"), at("StartTime").alias("start"), at("EndTime").alias("end"), tag_block(F.col("x"), "LineRef").alias("routes"))


def osm_stations(nodes: DataFrame) -> DataFrame:
    """Stations, stop positions and platforms of extracted nodes (osm_id, lon, lat, tags). [S5]"""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    mode = F.when(tag("station").isin("subway", "light_rail") | (tag("subway") == "yes"), "subway").when((tag("railway") == "tram_stop") | (tag("tram") == "yes"), "tram").when(tag("railway").isin("station", "halt", "stop", "platform") | (tag("train") == "yes"), "rail")
    kind = F.when(tag("railway").isin("station", "halt", "tram_stop"), "station").when((tag("public_transport") == "stop_position") | (tag("railway") == "stop"), "stop_position").when((tag("public_transport") == "platform") | (tag("railway") == "platform"), "platform").when(tag("public_transport") == "station", "station")
    names = F.map_filter("tags", lambda k, v: k.startswith("name:"))
    return nodes.select("osm_id", "lon", "lat", tag("name").alias("name"), names.alias("names"), mode.alias("mode_type"), kind.alias("station_type"), F.coalesce(tag("local_ref"), tag("ref")).alias("local_ref")).where("mode_type IS NOT NULL AND station_type IS NOT NULL")


def elected_parents(members: DataFrame) -> DataFrame:
    """Of each stop area (area_id, osm_id, kind_rank, role_rank, station_type) the station that is the parent of the rest. [D42]"""
    able = F.when(F.col("station_type") == "station", F.struct(F.col("kind_rank") * 10 + F.col("role_rank"), "osm_id"))
    return members.groupBy("area_id").agg(F.min_by("osm_id", able).alias("parent_osm_id")).where("parent_osm_id IS NOT NULL")


def _mode_allowed(tags: str, keys: list[str]) -> Column:
    """The most special tag that is set decides."""
    value = F.coalesce(*[F.try_element_at(tags, F.lit(k)) for k in keys])
    return ~F.coalesce(value.isin("no", "private", "use_sidepath"), F.lit(False))


def street_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between consecutive nodes of routable ways (way_id, node_ids, tags), with access and speed. [S6, G1]"""
    from tramline.functions.geo import haversine

    tag = lambda k: F.try_element_at("tags", F.lit(k))
    road = ways.where(tag("highway").isNotNull())
    steps = road.select("way_id", "tags", F.posexplode("node_ids").alias("i", "from_node"), "node_ids").withColumn("to_node", F.get("node_ids", F.col("i") + 1)).where("to_node IS NOT NULL").drop("node_ids")
    a, b = (nodes.select(F.col("node_id").alias(f"{e}_node"), F.col("lon").alias(f"{e}_lon"), F.col("lat").alias(f"{e}_lat")) for e in ("from", "to"))
    placed = steps.join(a, "from_node").join(b, "to_node")
    speed = F.coalesce(F.regexp_extract(tag("maxspeed"), "^([0-9]+)", 1).try_cast("int") * F.when(tag("maxspeed").contains("mph"), 1.609344).otherwise(1.0), F.lit(50.0))
    closed = tag("highway").isin("motorway", "motorway_link", "trunk")
    return placed.select("way_id", "from_node", "to_node", haversine(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat")).alias("metres"),
                         (~closed & _mode_allowed("tags", ["foot", "access"])).alias("foot"), (~tag("highway").isin("footway", "path", "steps", "cycleway", "pedestrian") & _mode_allowed("tags", ["motor_vehicle", "vehicle", "access"])).alias("car"),
                         (F.coalesce(tag("oneway"), F.lit("no")) == "yes").alias("oneway"), tag("highway").isin("primary", "secondary", "trunk").alias("big_street"), (tag("highway") == "steps").alias("steps"), speed.cast("int").alias("speed_kmh"))


def rail_segments(ways: DataFrame) -> DataFrame:
    """Rail ways cut where several meet: way_id, segment, node_ids from one shared node or end to the next. [S7]"""
    steps = ways.select("way_id", F.posexplode("node_ids").alias("i", "node"), F.size("node_ids").alias("n"))
    shared = steps.groupBy("node").agg((F.count("*") > 1).alias("shared"))
    marked = steps.join(shared, "node").withColumn("cut", F.col("shared") & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1))
    numbered = marked.withColumn("segment", F.coalesce(F.sum(F.col("cut").cast("int")).over(Window.partitionBy("way_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = numbered.select("way_id", "segment", "i", "node").unionByName(numbered.where("cut").select("way_id", (F.col("segment") + 1).alias("segment"), "i", "node"))
    return both.groupBy("way_id", "segment").agg(F.transform(F.sort_array(F.collect_set(F.struct("i", "node"))), lambda s: s["node"]).alias("node_ids"))


def message_stream(spark: SparkSession, folder: str, ddl: str = RAW_MESSAGES, files: int = 100) -> DataFrame:
    """Realtime messages as files that pollers drop into a folder, of Parquet; bounded files a batch. [S8]"""
    return spark.readStream.schema(struct(ddl)).option("maxFilesPerTrigger", files).parquet(folder)


def decoded(messages: DataFrame, ddl: str, body: str = "body") -> DataFrame:
    """Messages whose body is JSON of a known schema, one row each; malformed ones give nulls. [S9, S11]"""
    return messages.withColumn("message", F.from_json(F.col(body).cast("string"), ddl)).select(*[c for c in messages.columns if c != body], "message.*")
