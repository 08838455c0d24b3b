"""Where results go: partitioned tables, merges into them, exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.text import hex_colour, kml_colour, xml_escaped


def append(df: DataFrame, path: str, by: str = "chateau") -> None:
    """Rows into a table partitioned by ``by``; dealt out by it first, so a partition gets few files. [K1]"""
    df.repartition(by).write.mode("append").partitionBy(by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that ``df`` has are replaced. [K6, K13]"""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new version of a whole table beside the old ones; readers see it once its pointer is written. [K13, S18]"""
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{root}/_current")
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest version whose pointer is there. [S18]"""
    version = spark.read.schema("version long").json(f"{root}/_current").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v={version}")


def geojson_feature(points: Column, properties: Column) -> Column:
    """A line as a GeoJSON feature. [K9, K11, D47, D51]"""
    coordinates = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def gpx_track(points: Column, name: Column) -> Column:
    """A line as a GPX track element. [K9]"""
    spots = F.transform(points, lambda p: F.concat(F.lit('<trkpt lat="'), p["lat"], F.lit('" lon="'), p["lon"], F.lit('"/>')))
    return F.concat(F.lit("<trk><name>"), xml_escaped(name), F.lit("</name><trkseg>"), F.array_join(spots, ""), F.lit("</trkseg></trk>"))


def kml_placemark(points: Column, name: Column, colour: Column) -> Column:
    """A line as a KML placemark. [K9]"""
    spots = F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["lon"], p["lat"])), " ")
    return F.concat(F.lit("<Placemark><name>"), xml_escaped(name), F.lit("</name><Style><LineStyle><color>"), kml_colour(hex_colour(colour, "000000")), F.lit("</color></LineStyle></Style><LineString><coordinates>"), spots, F.lit("</coordinates></LineString></Placemark>"))


def message_json(df: DataFrame) -> DataFrame:
    """Rows as JSON messages. [K12]"""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def put_tiles(tiles: DataFrame, path: str) -> None:
    """A tile cache of (category, z, x, y, body), replaced by category and zoom. [K7]"""
    replace_partitions(tiles, path, ["category", "z"])


def without_tiles(cache: DataFrame, category: str, z: int, box: tuple[int, int, int, int]) -> DataFrame:
    """The cache without the tiles in a box of x and y. [K7]"""
    inside = (F.col("category") == category) & (F.col("z") == z) & F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    return cache.where(~inside)


def describe(df: DataFrame) -> str:
    """Schema as JSON, for whoever reads an export."""
    return json.dumps(json.loads(df.schema.json()))
