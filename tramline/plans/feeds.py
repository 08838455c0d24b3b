"""Realtime feeds in their wire format over the benchmark tables: events are packed to messages, which are then read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tramline.functions.protobuf import packed
from tramline.plans.registry import Tables, query
from tramline.sources import realtime


def _message(rows):
    """A feed with a vehicle, an update and an alert for each event."""
    out = []
    for r in rows:
        e, u = r["event_id"], r["user_id"]
        trip = packed((1, f"t{u}"), (2, "07:00:00"), (3, "20240105"), (4, 3 if u % 5 == 0 else 0), (5, f"r{u % 10}"))
        out.append(packed((1, f"v{e}"), (4, packed((1, trip), (2, packed((1, float(u % 90)), (2, -float(e % 180)))), (5, 1_700_000_000 + e), (8, packed((1, f"id{e}"), (2, f"label{e}")))))))
        calls = [packed((1, k), (2, packed((1, -(e % 100) - k), (2, 1_700_000_000 + 60 * k))), (4, f"s{k}"), (5, 1 if k == 2 else None)) for k in range(1, 2 + e % 3)]
        out.append(packed((1, f"u{e}"), (3, packed((1, trip), *[(2, c) for c in calls], (4, 1_700_000_001), (5, e % 7)))))
        about = packed((2, f"r{u % 10}"), (4, packed((1, f"t{u}"))))
        out.append(packed((1, f"a{e}"), (2, 1 if e % 9 == 0 else 0), (5, packed((1, packed((1, 100 + e), (2, 200 + e))), (5, about), (6, 4), (7, 1 + e % 3), (10, packed((1, packed((1, f"Head {e}"), (2, "en")))))))))
    return realtime.feed_bytes(1_700_000_000 + len(rows), out)


def _bodies(batches):
    """Messages are made and handed on a few at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, 50):
            part = batch.slice(first, 50)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_message, part.column(1).to_pylist()), pa.binary())], ["feed_id", "body"])


def _messages(t: Tables):
    rows = t.events.groupBy((F.col("event_id") % 100).alias("feed_id"), F.floor(F.col("event_id") / 2000).alias("n")).agg(F.collect_list(F.struct("event_id", "user_id")).alias("rows"))
    return rows.select("feed_id", "rows").mapInArrow(_bodies, "feed_id long, body binary")


@query("SELECT event_id % 100 AS feed_id, 1700000000 + count(*) AS header_ts FROM events GROUP BY 1, event_id // 2000")
def header_peek(t: Tables):
    """[F8]"""
    return _messages(t).select("feed_id", realtime.header_timestamp("body").alias("header_ts"))


@query("""SELECT event_id % 100 AS feed_id, 'v' || event_id AS entity_id, 't' || user_id AS trip_id, 'r' || user_id % 10 AS route_id, CASE WHEN user_id % 5 = 0 THEN 'CANCELED' ELSE 'SCHEDULED' END AS status, 'label' || event_id AS vehicle_label,
CAST(user_id % 90 AS DOUBLE) AS lat, -CAST(event_id % 180 AS DOUBLE) AS lon, 1700000000 + event_id AS timestamp FROM events""")
def decoded_vehicles(t: Tables):
    """[S8, S9]"""
    out = realtime.entities(_messages(t), "vehicle")
    return out.select("feed_id", "entity_id", "trip_id", "route_id", F.col("schedule_relationship").alias("status"), "vehicle_label", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "timestamp")


@query("""SELECT event_id % 100 AS feed_id, 'u' || event_id AS entity_id, CAST(event_id % 7 AS INTEGER) AS delay, CAST(k AS INTEGER) AS stop_sequence, 's' || k AS stop_id, CAST(-(event_id % 100) - k AS INTEGER) AS arrival_delay, 1700000000 + 60 * k AS arrival, CASE WHEN k = 2 THEN 'SKIPPED' ELSE 'SCHEDULED' END AS status
FROM (SELECT event_id, unnest(range(1, 2 + event_id % 3)) AS k FROM events)""")
def decoded_updates(t: Tables):
    """[S8, S9, S11]"""
    out = realtime.entities(_messages(t), "trip_update").select("feed_id", "entity_id", "delay", F.explode("stop_time_update").alias("c"))
    return out.select("feed_id", "entity_id", "delay", "c.stop_sequence", "c.stop_id", F.col("c.arrival.delay").alias("arrival_delay"), F.col("c.arrival.time").alias("arrival"), F.col("c.schedule_relationship").alias("status"))


@query("""SELECT event_id % 100 AS feed_id, 'a' || event_id AS entity_id, 4 AS cause, CAST(1 + event_id % 3 AS INTEGER) AS effect, 'Head ' || event_id AS header, 100 + event_id AS start, 'r' || user_id % 10 AS route_id, 't' || user_id AS trip_id FROM events WHERE event_id % 9 <> 0""")
def decoded_alerts(t: Tables):
    """[S8]"""
    out = realtime.entities(_messages(t), "alert")
    about = F.get("informed_entity", F.lit(0))
    return out.select("feed_id", "entity_id", "cause", "effect", F.col("header")["en"].alias("header"), F.get("active_period", F.lit(0))["start"].alias("start"), about["route_id"].alias("route_id"), about["trip_id"].alias("trip_id"))
