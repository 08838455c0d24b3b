"""GTFS Realtime messages as rows: a pass over Arrow batches of message bodies, one row for each entity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions import protobuf as pb

#: Entities read before they are handed on; a worker holds no more, however many its messages have.
PART_ROWS = 1_000

#: Names of enum values, by number; fixed values of the public specification.
TRIP_STATUS = {0: "SCHEDULED", 1: "ADDED", 2: "UNSCHEDULED", 3: "CANCELED", 5: "REPLACEMENT", 6: "DUPLICATED", 7: "DELETED", 8: "NEW"}
STOP_STATUS = {0: "SCHEDULED", 1: "SKIPPED", 2: "NO_DATA", 3: "UNSCHEDULED"}

_EVENT = "struct<time:long,delay:int>"
_COMMON = "entity_id string, header_ts long, trip_id string, route_id string, start_date string, start_time string, schedule_relationship string, vehicle_id string, vehicle_label string, timestamp long"
VEHICLES = f"{_COMMON}, lat float, lon float, bearing float, speed float, stop_id string, current_stop_sequence int"
UPDATES = f"{_COMMON}, delay int, stop_time_update array<struct<stop_sequence:int,stop_id:string,arrival:{_EVENT},departure:{_EVENT},schedule_relationship:string>>"
ALERTS = (
    "entity_id string, header_ts long, cause int, effect int, header map<string,string>, description map<string,string>, url map<string,string>, "
    "active_period array<struct<start:long,end:long>>, informed_entity array<struct<agency_id:string,route_id:string,route_type:int,stop_id:string,trip_id:string>>"
)


@F.udf(T.LongType(), useArrow=True)
def header_timestamp(body):
    """[F8]"""
    return None if body is None else pb.header_timestamp(bytes(body))


def _trip(trip: dict, vehicle: dict, entity_id: str | None, header: int | None, timestamp: int | None) -> dict:
    status = pb.number(trip, 4)
    return {
        "entity_id": entity_id, "header_ts": header, "trip_id": pb.text(trip, 1), "route_id": pb.text(trip, 5), "start_date": pb.text(trip, 3), "start_time": pb.text(trip, 2),
        "schedule_relationship": TRIP_STATUS.get(status or 0), "vehicle_id": pb.text(vehicle, 1), "vehicle_label": pb.text(vehicle, 2), "timestamp": timestamp,
    }


def _event(call: dict, key: int) -> dict | None:
    found = pb.inner(call, key)
    return {"time": pb.number(found, 2), "delay": pb.number(found, 1)} if found else None


def _vehicle(body: dict, entity_id: str | None, header: int | None) -> dict:
    place = pb.inner(body, 2)
    row = _trip(pb.inner(body, 1), pb.inner(body, 8), entity_id, header, pb.number(body, 5))
    return row | {"lat": pb.real(place, 1), "lon": pb.real(place, 2), "bearing": pb.real(place, 3), "speed": pb.real(place, 5), "stop_id": pb.text(body, 7), "current_stop_sequence": pb.number(body, 3)}


def _update(body: dict, entity_id: str | None, header: int | None) -> dict:
    calls = [pb.message(x) for x in body.get(2, []) if isinstance(x, bytes)]
    rows = [{"stop_sequence": pb.number(c, 1), "stop_id": pb.text(c, 4), "arrival": _event(c, 2), "departure": _event(c, 3), "schedule_relationship": STOP_STATUS.get(pb.number(c, 5) or 0)} for c in calls]
    return _trip(pb.inner(body, 1), pb.inner(body, 3), entity_id, header, pb.number(body, 4)) | {"delay": pb.number(body, 5), "stop_time_update": rows}


def _texts(body: dict, key: int) -> list[tuple[str, str]]:
    found = [pb.message(x) for x in pb.inner(body, key).get(1, []) if isinstance(x, bytes)]
    return list({pb.text(x, 2) or "": pb.text(x, 1) or "" for x in found}.items())


def _alert(body: dict, entity_id: str | None, header: int | None) -> dict:
    periods = [{"start": pb.number(p, 1), "end": pb.number(p, 2)} for p in map(pb.message, body.get(1, []))]
    about = [{"agency_id": pb.text(e, 1), "route_id": pb.text(e, 2), "route_type": pb.number(e, 3), "stop_id": pb.text(e, 5), "trip_id": pb.text(pb.inner(e, 4), 1)} for e in map(pb.message, body.get(5, []))]
    return {"entity_id": entity_id, "header_ts": header, "cause": pb.number(body, 6), "effect": pb.number(body, 7), "header": _texts(body, 10), "description": _texts(body, 11), "url": _texts(body, 8), "active_period": periods, "informed_entity": about}


_KINDS = {"trip_update": (3, _update, UPDATES), "vehicle": (4, _vehicle, VEHICLES), "alert": (5, _alert, ALERTS)}


def entities(messages: DataFrame, kind: str, *, body: str = "body", feed: str = "feed_id") -> DataFrame:
    """``feed`` and the columns of one kind of entity ('trip_update', 'vehicle' or 'alert'), a row for each. [S8, S9, S11, K12]

    Works on batches and streams alike. A null body has no entities; one that is no message gives none, too, as a feed
    that is cut short must not stop the others. Deleted entities are left out.
    """
    number, read, ddl = _KINDS[kind]
    own = dict(messages.dtypes)[feed]
    schema = T.StructType.fromDDL(f"`{feed}` {own}, {ddl}") if isinstance(ddl, str) else ddl
    arrow = _arrow(schema)

    def rows(name: object, data: bytes | None) -> Iterator[dict]:
        try:
            found = pb.message(data or b"")
            header = pb.number(pb.inner(found, 1), 3)
            for entity in map(pb.message, found.get(2, [])):
                inside = pb.inner(entity, number)
                if inside and not pb.number(entity, 2):
                    yield {feed: name} | read(inside, pb.text(entity, 1), header)
        except (ValueError, TypeError):
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for name, data in zip(*batch.columns, strict=True) for row in rows(name.as_py(), data.as_py()))
        while part := list(islice(found, PART_ROWS)):
            yield pa.RecordBatch.from_pylist(part, arrow)

    return messages.select(feed, body).mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def feed_bytes(header_ts: int | None, found: list[bytes]) -> bytes:
    """A feed message of entities that are packed already. [K12]"""
    return pb.packed((1, pb.packed((1, "2.0"), (3, header_ts))), *[(2, x) for x in found])
