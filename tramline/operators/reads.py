"""Reads that applications make: trips, routes, stations, vehicles, viewports. Each answers all its requests in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine
from tramline.operators.departures import departure_order, in_window
from tramline.operators.realtime import nearest_service_date, overlay
from tramline.operators.spatial import radius_join


def trip_details(asked: DataFrame, trips: DataFrame, calls: DataFrame, stops: DataFrame, days: DataFrame, updates: DataFrame, alerts: DataFrame) -> DataFrame:
    """All calls of the trips asked for, on the nearest service day, with realtime, stop names and alerts. [D13]

    ``asked``: trip_id, observed (a date); ``days``: service_id, date, midnight; ``trips``: trip_id, route_id, service_id,
    start_time; ``calls`` offsets from the start; ``updates`` as ``realtime.overlay`` takes them; ``alerts``: alert_id and
    one of route_id, stop_id, trip_id. A trip that no service day is near for is not answered.
    """
    own = asked.join(trips, "trip_id")
    dated = nearest_service_date(own, days)
    rows = dated.select("trip_id", "route_id", "date", "midnight", "start_time").join(calls, "trip_id")
    at = F.col("midnight") + F.col("start_time")
    laid = overlay(rows.select("trip_id", "date", "stop_sequence", "stop_id", (at + F.col("arrival")).alias("arrival"), (at + F.col("departure")).alias("departure"), "route_id"), updates)
    named = laid.join(stops.select("stop_id", F.col("name").alias("stop_name")), "stop_id", "left")
    for key in ("route_id", "stop_id", "trip_id"):
        about = alerts.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("alert_id").alias(f"__{key}"))
        named = named.join(about, key, "left")
    none = F.array().cast(dict(named.dtypes)["__stop_id"])
    return named.withColumn("alert_ids", F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f"__{k}", none) for k in ("route_id", "stop_id", "trip_id")])))).drop("__route_id", "__stop_id", "__trip_id")


def route_info(routes: DataFrame, agencies: DataFrame, trips: DataFrame, calls: DataFrame, stops: DataFrame, alerts: DataFrame) -> DataFrame:
    """A row for each route: agency, its direction patterns, stops, box, alerts and the routes it meets at a stop. [D16, A8]

    ``routes``: route_id, agency_id; ``agencies``: agency_id, agency_name; ``trips``: trip_id, route_id, headsign. Stops are
    reduced to distinct (route, stop) first, so later joins don't grow with the number of trips.
    """
    listed = calls.groupBy("trip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id"))), lambda c: c["stop_id"]).alias("stop_ids"))
    patterns = trips.join(listed, "trip_id").groupBy("route_id", "headsign", "stop_ids").agg(F.count("*").alias("n_trips"))
    directions = patterns.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("headsign", F.size("stop_ids").alias("n_stops"), "n_trips"))).alias("directions"))
    at = patterns.select("route_id", F.explode("stop_ids").alias("stop_id")).distinct()
    places = at.join(stops.select("stop_id", "lon", "lat"), "stop_id").groupBy("route_id").agg(F.count("*").alias("n_stops"), *[f(c).alias(n) for n, f, c in (("west", F.min, "lon"), ("south", F.min, "lat"), ("east", F.max, "lon"), ("north", F.max, "lat"))])
    sets = stop_routes(at).select("stop_id", "route_ids")
    gathered = at.join(sets, "stop_id").select("route_id", "route_ids").repartition("route_id")
    met = gathered.groupBy("route_id").agg(F.size(F.array_remove(F.array_distinct(F.flatten(F.collect_list("route_ids"))), F.col("route_id"))).cast("long").alias("n_connecting"))
    told = alerts.where("route_id IS NOT NULL").groupBy("route_id").agg(F.array_sort(F.collect_set("alert_id")).alias("alert_ids"))
    out = routes.join(agencies, "agency_id", "left")
    for part in (directions, places, met, told):
        out = out.join(part, "route_id", "left")
    return out.withColumn("n_connecting", F.coalesce("n_connecting", F.lit(0)))


def stop_routes(rows: DataFrame) -> DataFrame:
    """Of each stop the distinct routes (and types, where given) that call there, in order of their ids. [A8, O5]"""
    kinds = [F.array_sort(F.collect_set("route_type")).alias("route_types")] if "route_type" in rows.columns else []
    return rows.groupBy("stop_id").agg(F.array_sort(F.collect_set("route_id")).alias("route_ids"), *kinds)


def shape_colours(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """shape_id, its routes, and the colour of the least of them that has one. [A23]"""
    pairs = trips.where("shape_id IS NOT NULL").select("shape_id", "route_id").distinct().join(routes.select("route_id", "colour"), "route_id", "left")
    return pairs.groupBy("shape_id").agg(F.array_sort(F.collect_set("route_id")).alias("route_ids"), F.min_by("colour", F.when(F.col("colour").isNotNull(), F.col("route_id"))).alias("colour"))


def nearby_board(asked: DataFrame, calls: DataFrame, stops: DataFrame, start: int, end: int, *, metres: float = 5_000, per_station: int = 10, per_headsign: int = 20, chunk: int = 5) -> DataFrame:
    """Departures of the stations around points, in chunks of stations from near to far. [D8, D9, W8, O2]

    ``asked``: ask_id, lon, lat; ``stops``: stop_id, r_lon, r_lat, osm_id, parent_station, route_type. Stops are grouped by
    merged station, else parent, else the stop itself; a station is as far as its nearest stop. ``calls`` have realtime
    laid over before the window applies. ``long_distance`` marks calls at rail stops. Bounded per headsign of a
    station, then per station; ``chunk`` numbers the messages that a client gets one after the other.
    """
    group = F.coalesce(F.concat(F.lit("o"), "osm_id"), F.concat(F.lit("p"), "parent_station"), F.concat(F.lit("s"), "stop_id"))
    near = radius_join(asked, stops.withColumn("station", group), metres).select("ask_id", "stop_id", "station", "route_type", "metres")
    order = F.dense_rank().over(Window.partitionBy("ask_id").orderBy("station_metres", "station"))
    by_station = near.groupBy("ask_id", "station").agg(F.min("metres").alias("station_metres")).withColumn("chunk", F.floor((order - 1) / chunk))
    events = calls.where(in_window(start, end)).withColumn("sort_time", departure_order()).join(near, "stop_id")
    first = ["sort_time", "trip_id", "stop_sequence"]
    kept = events.withColumn("__h", F.row_number().over(Window.partitionBy("ask_id", "station", "headsign").orderBy(*first))).where(F.col("__h") <= per_headsign)
    kept = kept.withColumn("__s", F.row_number().over(Window.partitionBy("ask_id", "station").orderBy(*first))).where(F.col("__s") <= per_station).drop("__h", "__s")
    return kept.join(by_station, ["ask_id", "station"]).withColumn("long_distance", F.col("route_type") == 2)


#: Metres that a connecting stop may be away, by the mode asked for (rows) and its own: bus, tram, metro, rail, others.
#: Fixed values.
CONNECTION_METRES = {0: (150, 200, 200, 400, 300), 1: (150, 200, 200, 400, 300), 2: (200, 300, 300, 300, 300), None: (150, 200, 200, 300, 300)}


def connection_reach(own: Column, other: Column) -> Column:
    """[J15]"""

    def row(metres: tuple[int, ...]) -> Column:
        out = F.lit(metres[4])
        for kind, value in zip((3, 0, 1, 2), metres, strict=False):
            out = F.when(other == kind, value).otherwise(out)
        return out

    out = row(CONNECTION_METRES[None])
    for mode in (0, 1, 2):
        out = F.when(own == mode, row(CONNECTION_METRES[mode])).otherwise(out)
    return out


def connections(base: DataFrame, others: DataFrame) -> DataFrame:
    """Each other stop with the nearest of the base stops that are near enough for both modes; a base stop is its own,
    else the least id of equals. [D17, J15] ``base``: stop_id, lon, lat, route_type; ``others``: other_id, r_lon, r_lat, r_type.

    Stops of one position and mode have the same neighbours, so positions are matched, with the least id of each; an
    other stop's own base stop, which goes before equals, is met by its id.
    """
    reach = connection_reach(F.col("route_type"), F.col("r_type"))
    kinds = base.groupBy("lon", "lat", "route_type").agg(F.min("stop_id").alias("stop_id"))
    asked = others.select("r_lon", "r_lat", "r_type").distinct()
    near = radius_join(kinds, asked, 400.0).where(F.col("metres") <= reach)
    best = near.groupBy("r_lon", "r_lat", F.coalesce("r_type", F.lit(-1)).alias("r_type")).agg(F.min(F.struct("metres", "stop_id")).alias("m"))
    told = others.select("other_id", "r_lon", "r_lat", F.coalesce("r_type", F.lit(-1)).alias("r_type")).join(best.hint("merge"), ["r_lon", "r_lat", "r_type"]).select("other_id", "m.*")
    itself = others.join(base.hint("merge"), F.col("other_id") == F.col("stop_id")).withColumn("metres", haversine(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))).where(F.col("metres") <= reach)
    found = told.unionByName(itself.select("other_id", "metres", "stop_id"))
    return found.groupBy("other_id").agg(F.min(F.struct("metres", (F.col("stop_id") != F.col("other_id")).alias("far"), "stop_id")).alias("m")).select("other_id", "m.stop_id", "m.metres")


def vehicles(positions: DataFrame, *, chateau: str | None = None, route_types: list[int] | None = None, gtfs_id: str | None = None, label: str | None = None) -> DataFrame:
    """Vehicle positions by tenant, mode, id or label; each filter that is given applies, and reaches the scan. [D27]"""
    for column, value in (("chateau", chateau), ("vehicle_id", gtfs_id), ("vehicle_label", label)):
        positions = positions.where(F.col(column) == value) if value is not None else positions
    return positions.where(F.col("route_type").isin(route_types)) if route_types else positions


def route_cache(routes: DataFrame, known: DataFrame) -> DataFrame:
    """chateau, ``hash`` of its routes, and ``changed`` where a client knows another hash or none: only then are routes sent. [D27, F28]"""
    each = routes.groupBy("chateau").agg(F.sum(F.xxhash64(*[c for c in routes.columns if c != "chateau"]).cast("decimal(38,0)")).cast("string").alias("hash"), F.count("*").alias("n_routes"))
    return each.join(known.select("chateau", F.col("hash").alias("__known")), "chateau", "left").withColumn("changed", ~F.col("hash").eqNullSafe(F.col("__known"))).drop("__known")


def updates_of(updates: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """Trip updates for some trips (modified ones under either id), routes or stops; ``by`` names the key. [D28]"""
    if by == "trip_id" and "modified_trip_id" in updates.columns:
        wide = updates.withColumn("__key", F.explode(F.array_distinct(F.array_compact(F.array("trip_id", "modified_trip_id")))))
    elif by == "stop_id":
        wide = updates.withColumn("__key", F.explode(F.array_distinct("stop_ids")))
    else:
        wide = updates.withColumn("__key", F.col(by))
    return wide.join(keys.select(F.col(by).alias("__key")).distinct(), "__key", "left_semi").drop("__key").dropDuplicates(["update_id"])


def route_realtime(route_ids: DataFrame, positions: DataFrame, updates: DataFrame, calls: DataFrame) -> DataFrame:
    """Of each route asked for: its vehicles, updates and stops with a realtime call. [D30]"""
    own = updates.join(route_ids.select("route_id"), "route_id", "left_semi")
    seen = positions.join(route_ids.select("route_id"), "route_id", "left_semi").groupBy("route_id").agg(F.count_distinct("vehicle_id").alias("n_vehicles"))
    changed = own.groupBy("route_id").agg(F.count_distinct("trip_id").alias("n_trips"))
    at = calls.join(own.select("route_id", "trip_id").distinct(), "trip_id").groupBy("route_id").agg(F.count_distinct("stop_id").alias("n_stops"))
    out = route_ids.select("route_id")
    for part in (seen, changed, at):
        out = out.join(part, "route_id", "left")
    return out.na.fill(0)


def in_viewport(points: DataFrame, views: DataFrame, cell: float = 0.0625, on: tuple[str, ...] = ()) -> DataFrame:
    """``points`` (lon, lat) with ``view_id`` of each view whose box (west, south, east, north) holds them. [J18, D26, D29]

    Both meet by cells, so many views are an equality join, and by the columns ``on`` that both have. A box has cells of
    about a fourth of its longer side: ``cell`` degrees, doubled or halved; points have one for each size in use. A box
    over the date line (west > east) is two boxes.
    """
    step = F.lit(cell) * F.pow(F.lit(2.0), F.col("__z"))
    at = lambda c: F.floor(c / step).cast("int")
    whole = F.struct("west", "south", "east", "north")
    halves = F.array(F.struct("west", "south", F.lit(180.0).alias("east"), "north"), F.struct(F.lit(-180.0).alias("west"), "south", "east", "north"))
    boxes = views.select("view_id", *on, F.explode(F.when(F.col("west") > F.col("east"), halves).otherwise(F.array(whole))).alias("b")).select("view_id", *on, "b.*")
    longest = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1e-4))
    boxes = boxes.where("west <= east AND south <= north").withColumn("__z", F.ceil(F.log2(longest / (4 * cell))).cast("int"))
    cells = boxes.withColumn("__x", F.explode(F.sequence(at(F.col("west")), at(F.col("east"))))).withColumn("__y", F.explode(F.sequence(at(F.col("south")), at(F.col("north")))))
    sizes = boxes.select("__z").distinct()  # a few rows, whatever the boxes
    placed = points.crossJoin(F.broadcast(sizes)).withColumn("__x", at(F.col("lon"))).withColumn("__y", at(F.col("lat")))
    keys = [*on, "__z", "__x", "__y"]
    found = placed.join(cells.hint("merge"), keys).where("lon BETWEEN west AND east AND lat BETWEEN south AND north")
    return found.select(*points.columns, *[c for c in cells.columns if c not in (*keys, "west", "south", "east", "north")])


def touching(boxes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose box meets an envelope: the exists test of hulls against a region. [J6, J18]"""
    return boxes.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))


def station_preview(stations: DataFrame, stops: DataFrame, routes_at: DataFrame) -> DataFrame:
    """Of each merged station its stops and the routes there, by mode. [D31, D7]

    ``stations``: osm_id, name; ``stops``: stop_id, osm_id; ``routes_at``: stop_id, route_id, route_type.
    """
    at = stops.where("osm_id IS NOT NULL").join(routes_at, "stop_id", "left").select("osm_id", "stop_id", "route_id", "route_type").distinct()
    grouped = at.groupBy("osm_id").agg(F.count_distinct("stop_id").alias("n_stops"), F.array_sort(F.collect_set("route_type")).alias("route_types"), F.count_distinct("route_id").alias("n_routes"))
    return stations.join(grouped, "osm_id", "left").withColumn("n_stops", F.coalesce("n_stops", F.lit(0))).withColumn("n_routes", F.coalesce("n_routes", F.lit(0)))


def agencies_of(agencies: DataFrame, routes: DataFrame, chateaus: DataFrame | None = None) -> DataFrame:
    """Agencies, of some tenants if given, with their routes in order. [D36, D48]"""
    kept = agencies if chateaus is None else agencies.join(chateaus.select("chateau"), "chateau", "left_semi")
    own = routes.groupBy("chateau", "agency_id").agg(F.array_sort(F.collect_list("route_id")).alias("route_ids"))
    return kept.join(own, ["chateau", "agency_id"], "left")


def vehicle_card(labels: DataFrame, positions: DataFrame, fleet: DataFrame, trips: DataFrame) -> DataFrame:
    """Of vehicle labels the last position, the kind of vehicle by its number, and the trip's route. [D50, J12]

    ``fleet`` is ``joins.fleet_of``'s table; a label without a vehicle is answered with nulls.
    """
    from tramline.operators.joins import fleet_of

    last = positions.groupBy("chateau", "vehicle_label").agg(F.max_by(F.struct("lon", "lat", "trip_id", "timestamp"), "timestamp").alias("p")).select("chateau", "vehicle_label", "p.*")
    asked = labels.select("chateau", "vehicle_label")
    kinds = fleet_of(asked.withColumn("label", F.col("vehicle_label")), fleet).select("chateau", "vehicle_label", "fleet")
    return asked.join(last, ["chateau", "vehicle_label"], "left").join(kinds, ["chateau", "vehicle_label"], "left").join(trips.select("trip_id", "route_id"), "trip_id", "left")


def distance_sorted(points: DataFrame, lon: float, lat: float) -> DataFrame:
    """[O2]"""
    return points.withColumn("metres", haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))).orderBy("metres")
