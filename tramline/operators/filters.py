"""Row filters with their consequences: what else goes when a row goes, and repairs of single columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Feed = dict[str, DataFrame]


def _semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def with_trips(feed: Feed, trips: DataFrame) -> Feed:
    """A feed cut down to some trips: their calls, stops (with parents and grandparents) and shapes. [P11]"""
    calls = _semi(feed["stop_times"], trips, "trip_id")
    stops = feed["stops"]
    used = _semi(stops, calls, "stop_id")
    parents = stops.join(used.select(F.col("parent_station").alias("stop_id")).distinct(), "stop_id", "left_semi")
    above = stops.join(parents.select(F.col("parent_station").alias("stop_id")).distinct(), "stop_id", "left_semi")
    return feed | {
        "trips": trips,
        "stop_times": calls,
        "stops": used.unionByName(parents).unionByName(above).dropDuplicates(["stop_id"]),
        "shapes": _semi(feed["shapes"], trips.where("shape_id IS NOT NULL"), "shape_id") if "shapes" in feed else None,
    }


def only_route_types(feed: Feed, types: list[int]) -> Feed:
    """[P11]"""
    routes = feed["routes"].where(F.col("route_type").isin(types))
    return with_trips(feed, _semi(feed["trips"], routes, "route_id")) | {"routes": routes}


def only_active_after(feed: Feed, days: DataFrame, date: str) -> Feed:
    """Trips of services that still run on or after a date. [P12]"""
    return with_trips(feed, _semi(feed["trips"], days.where(F.col("date") >= F.lit(date).cast("date")), "service_id"))


def without_agencies(feed: Feed, agencies: list[str]) -> Feed:
    """Agencies, their routes, trips and calls removed; routes without an agency stay. [P13]"""
    routes = feed["routes"].where(~F.coalesce(F.col("agency_id").isin(agencies), F.lit(False)))
    return with_trips(feed, _semi(feed["trips"], routes, "route_id")) | {"routes": routes}


def without_orphans(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """[P14]"""
    return _semi(stop_times, trips, "trip_id")


def valid_transfers(transfers: DataFrame, stops: DataFrame) -> DataFrame:
    """Transfers both of whose ends exist. [P15]"""
    ids = stops.select("stop_id").distinct()
    return transfers.join(ids.withColumnRenamed("stop_id", "from_stop_id"), "from_stop_id", "left_semi").join(ids.withColumnRenamed("stop_id", "to_stop_id"), "to_stop_id", "left_semi")


def repaired_direction(direction: Column) -> Column:
    """0 and 1 stay, all else is none. [P16]"""
    value = direction.try_cast("int")
    return F.when(value.isin(0, 1), value)


def valid_pathways(pathways: DataFrame) -> DataFrame:
    """Pathways with both ends, a known mode, and no negative length or time. [P16]"""
    return pathways.where("from_stop_id IS NOT NULL AND to_stop_id IS NOT NULL AND pathway_mode BETWEEN 1 AND 7 AND coalesce(length, 0) >= 0 AND coalesce(traversal_time, 0) >= 0")


def without_banned(alerts: DataFrame, texts: str, banned: list[str]) -> DataFrame:
    """Alerts none of whose texts (array column) holds a banned sentence. [P17]"""
    def any_in(text: Column) -> Column:
        hit = F.lit(False)
        for sentence in banned:
            hit = hit | F.contains(text, F.lit(sentence))
        return F.coalesce(hit, F.lit(False))

    return alerts.where(~F.coalesce(F.exists(texts, any_in), F.lit(False)))


def rolled_out(countries: Column, regions: Column, country: str = "CA", allowed: tuple[str, ...] = ("us-ca", "us-il", "us-ny", "us-dc", "us-ma")) -> Column:
    """Whether any level code is in the regions that a feature is on for; letter case doesn't matter. [P18]"""
    return F.coalesce(F.exists(countries, lambda c: F.lower(c) == country.lower()), F.lit(False)) | F.coalesce(F.exists(regions, lambda r: F.lower(r).isin(*allowed)), F.lit(False))


def least_importance(zoom: Column) -> Column:
    """How important a station must be to show at a zoom. [P7]"""
    return F.when(zoom <= 2, 2).when(zoom <= 5, 3).when(zoom <= 7, 5).otherwise(10)


def rewritten(df: DataFrame, rules: list[tuple[str, str, str, str]], feed: str = "feed_id") -> DataFrame:
    """Per-feed rewrites, each (feed, column, regex, replacement), in order. [P20]"""
    for own, column, regex, to in rules:
        df = df.withColumn(column, F.when(F.col(feed) == own, F.regexp_replace(column, regex, to)).otherwise(F.col(column)))
    return df


def enum_code(value: Column, codes: dict[str, int], default: int | None = None) -> Column:
    """A named value as its number. [P19]"""
    pairs = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.upper(value)), F.lit(default))
