"""Timetable feeds: zip archives and their text files as DataFrames."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.clock import compact_date, normalised_clock, seconds_of
from tramline.operators.calendar import DAYS, weekday_mask
from tramline.schemas import GTFS, struct


def unpack(archive: str | bytes, folder: str, depth: int = 3) -> str:
    """Unzip a feed; sub-folders are flattened and archives within unpacked. Returns the folder. [S1]

    A driver-side step over one archive of files; entries keep their base name only, so none can leave the folder.
    """
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(io.BytesIO(archive) if isinstance(archive, bytes) else archive) as found:
        for entry in found.infolist():
            name = os.path.basename(entry.filename)
            if entry.is_dir() or not name or name.startswith("."):
                continue
            if name.lower().endswith(".zip") and depth:
                unpack(found.read(entry), folder, depth - 1)
            else:
                with found.open(entry) as source, open(os.path.join(folder, name), "wb") as target:
                    while block := source.read(1 << 20):
                        target.write(block)
    return folder


def read_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One file by its header's names, typed by the schema; columns that it lacks are null, a missing file is empty. [S1]

    Types are never inferred. Values that don't fit are null.
    """
    want = struct(GTFS[name])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], want)
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(f"{folder}/{name}.txt")
    names = {c.lstrip("﻿").strip().lower(): c for c in rows.columns}
    value = lambda f: F.nullif(F.trim(F.col(f"`{names[f.name]}`")), F.lit("")).try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)
    return rows.select(*[value(f).alias(f.name) for f in want])


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All files of a feed, with times in seconds, dates as dates, weekday masks. [S1, S2]"""
    feed = {name: read_file(spark, folder, name) for name in GTFS}
    clock = lambda c: seconds_of(normalised_clock(F.col(c)))
    feed["stop_times"] = feed["stop_times"].withColumn("arrival", clock("arrival_time")).withColumn("departure", clock("departure_time"))
    feed["calendar"] = feed["calendar"].select("service_id", weekday_mask(*map(F.col, DAYS)).alias("mask"), compact_date(F.col("start_date")).alias("start_date"), compact_date(F.col("end_date")).alias("end_date"))
    feed["calendar_dates"] = feed["calendar_dates"].withColumn("date", compact_date(F.col("date")))
    feed["frequencies"] = feed["frequencies"].withColumn("start_time", clock("start_time")).withColumn("end_time", clock("end_time"))
    return feed


def calls_by_trip(stop_times: DataFrame) -> DataFrame:
    """trip_id and its calls in order; rows need not be grouped in the file. [S2]"""
    return stop_times.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id", "arrival", "departure"))).alias("calls"))


def lines(shapes: DataFrame) -> DataFrame:
    """shape_id and ``points`` (lon, lat) in order; shapes spill as any aggregate does. [S3]"""
    row = F.struct("shape_pt_sequence", F.col("shape_pt_lon").alias("lon"), F.col("shape_pt_lat").alias("lat"))
    sorted_rows = F.sort_array(F.collect_list(row))
    return shapes.groupBy("shape_id").agg(F.transform(sorted_rows, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def straight_lines(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """trip_id and ``points`` from stop to stop, for trips without a shape. [D38]"""
    row = F.struct("stop_sequence", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"))
    joined = calls.join(stops.select("stop_id", "stop_lon", "stop_lat"), "stop_id")
    return joined.groupBy("trip_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def one_agency(feed: dict[str, DataFrame], agency_id: str) -> dict[str, DataFrame]:
    """The part of a large feed that one agency runs. [S4]"""
    from tramline.operators.filters import with_trips

    routes = feed["routes"].where(F.col("agency_id") == agency_id)
    return with_trips(feed, feed["trips"].join(routes.select("route_id"), "route_id", "left_semi")) | {"routes": routes}


def translated(translations: DataFrame) -> DataFrame:
    """Per table, record and field a map of language to text, the least text of repeated ones. [S16]"""
    one = translations.groupBy("table_name", "record_id", "field_name", "language").agg(F.min("translation").alias("translation"))
    return one.groupBy("table_name", "record_id", "field_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "translation")))).alias("texts"))


def folder_hash(spark: SparkSession, folder: str) -> str:
    """One hash of all files but PDFs, by name and content; equal means nothing to ingest. [S17]"""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(~F.lower("path").endswith(".pdf"))
    each = files.select(F.sha2(F.concat(F.element_at(F.split("path", "/"), -1).cast("binary"), "content"), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256)).first()[0]
