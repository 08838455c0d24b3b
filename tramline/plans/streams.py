"""The streaming operators over the events, run until the source is dry; SQL says what a finished table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.plans.registry import Tables, query
from tramline.streaming import operators
from tramline.streaming.run import drained, last_of, staged


def _stream(t: Tables):
    """The events as a stream; the brackets make the path one that a streaming source takes, be it a file or a folder."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t._folder}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks take no other type


@query("""WITH p AS (SELECT user_id % 60 AS feed_id, event_id AS fetched_ms, k AS kind, CASE WHEN (event_id + k) % 11 = 0 THEN NULL ELSE (event_id // 300 + k * (event_id % 2)) % 4 END AS header_ts FROM events, (SELECT unnest([1, 2]) AS k)),
s AS (SELECT *, last_value(nullif(header_ts, 0) IGNORE NULLS) OVER (PARTITION BY feed_id, kind ORDER BY fetched_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
n AS (SELECT *, bool_or(header_ts IS NULL OR header_ts = 0 OR before IS DISTINCT FROM header_ts) OVER (PARTITION BY feed_id, fetched_ms) AS passes FROM s)
SELECT feed_id, fetched_ms, kind FROM n WHERE passes""")
def header_dedup(t: Tables):
    """All kinds of a poll pass if any is new; a time of null or 0 is always new. [T2, T5]"""
    e = F.col("event_id")
    kinds = _stream(t).select((F.col("user_id") % 60).alias("feed_id"), e.alias("fetched_ms"), e, F.explode(F.array(F.lit(1), F.lit(2))).alias("kind"))
    polls = kinds.select("feed_id", "fetched_ms", "kind", F.when((e + F.col("kind")) % 11 != 0, (F.floor(e / 300) + F.col("kind") * (e % 2)) % 4).alias("header_ts"))
    return drained(operators.header_gate(polls)).select("feed_id", "fetched_ms", "kind")


@query("""WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, user_id, event_type FROM l WHERE before IS DISTINCT FROM event_type""")
def content_dedup(t: Tables):
    """[T1, T7]"""
    return drained(operators.changed_only(_stream(t).select("event_id", "user_id", "event_type"), ["user_id"], "event_type", "event_id")).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2")
def latest_state(t: Tables):
    """[T3, T14]"""
    rows = _stream(t).select("user_id", "event_type", "event_id", "ts", F.struct("ts", "event_id").alias("at"))
    return last_of(drained(operators.latest(rows, ["user_id", "event_type"], "at"), "update"), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "ts")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(t: Tables):
    """[T9]"""
    return last_of(drained(operators.windowed(_stream(t), "ts", "1 hour", keys=("event_type",)), "update"), ["start", "event_type"]).select("start", "event_type", "n")


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, count(*) AS n FROM events, (SELECT unnest(range(4)) AS k) GROUP BY 1""")
def sliding_window(t: Tables):
    """[T9]"""
    return last_of(drained(operators.windowed(_stream(t), "ts", "1 hour", "15 minutes"), "update"), ["start"]).select("start", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, start, n FROM w WHERE stop <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def session_window(t: Tables):
    """The sessions that the watermark has closed. [T9, T10]"""
    return drained(operators.sessions(_stream(t), "ts", "2 hours", ("user_id",))).select("user_id", "start", "n")


@query("""WITH e AS (SELECT ts, event_id % 3 AS c, date_trunc('day', ts) AS d FROM events), m AS (SELECT c, max(ts) - INTERVAL 10 DAY AS w FROM e GROUP BY 1)
SELECT d AS start, count(*) AS n FROM e WHERE c < 2 OR d + INTERVAL 1 DAY > (SELECT w FROM m WHERE c = 0) GROUP BY 1""")
def late_data_drop(t: Tables):
    """Three batches; rows of windows that the watermark has passed are dropped; it takes hold one batch after the next. [T5, T10]"""
    stream, _ = staged(t.events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("c")), "c", [0, 1, 2])
    return last_of(drained(operators.windowed(stream, "ts", "1 day", late="10 days"), "update"), ["start"]).select("start", "n")


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id AS vehicle_id, count(*) AS n, min(event_id) AS oldest, max(event_id) AS newest FROM e WHERE r <= 5 GROUP BY 1""")
def recent_positions(t: Tables):
    """The last five positions of vehicles that never turn back. [T8, J21]"""
    e = F.col("event_id")
    rows = _stream(t).select(F.col("user_id").alias("vehicle_id"), e.alias("timestamp"), e.cast("double").alias("lon"), F.lit(1.0).alias("lat"))
    out = last_of(drained(operators.recent_positions(rows), "update", timed=True), ["vehicle_id"])
    return out.select("vehicle_id", F.size("times").cast("long").alias("n"), F.array_min("times").alias("oldest"), F.array_max("times").alias("newest"))


@query("SELECT user_id, max_by(event_type, event_id) AS value, false AS gone FROM events GROUP BY 1")
def grace_retention(t: Tables):
    """[T6]"""
    rows = _stream(t).select("user_id", F.col("event_type").alias("value"), "event_id")
    return last_of(drained(operators.with_grace(rows, ["user_id"], "value", "event_id"), "update", timed=True), ["user_id"]).select("user_id", "value", "gone")


@query("SELECT event_id, s_suppkey AS subscriber FROM events JOIN supplier ON user_id % 100 = s_suppkey % 100 WHERE s_suppkey <= 500")
def subscriptions(t: Tables):
    """[T11]"""
    asked = t.supplier.where("s_suppkey <= 500").select((F.col("s_suppkey") % 100).alias("chateau"), F.col("s_suppkey").alias("subscriber"))
    return drained(operators.subscribed(_stream(t).select("event_id", (F.col("user_id") % 100).alias("chateau")), asked)).select("event_id", "subscriber")


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'bus' ELSE 'rail' END AS category, event_id % 64 AS x, event_id // 64 % 64 AS y, 10 AS ts FROM events),
r AS (SELECT n_nationkey AS s, CASE WHEN n_nationkey % 2 = 0 THEN 'bus' ELSE 'rail' END AS category, n_nationkey % 5 * 10 AS w, n_nationkey % 5 * 10 + 15 AS e, n_nationkey % 3 = 0 AS fresh, n_nationkey % 4 = 1 AS known FROM nation)
SELECT s AS subscriber, event_id, NOT (known AND NOT fresh) AS replace_all FROM t JOIN r USING (category) WHERE x BETWEEN w AND e AND y BETWEEN 5 AND 40 AND (NOT (known AND NOT fresh) OR NOT (x BETWEEN w - 5 AND e - 5 AND y BETWEEN 5 AND 40))""")
def delta_push(t: Tables):
    """[T12, D29, K14]"""
    e, k = F.col("event_id"), F.col("n_nationkey")
    mode = lambda c: F.when(c % 2 == 0, "bus").otherwise("rail")
    tiles = t.events.select(mode(e).alias("category"), (e % 64).alias("x"), (F.floor(e / 64) % 64).alias("y"), e.alias("body"), F.lit(10).alias("feed_ts"))
    west, known = k % 5 * 10, k % 4 == 1
    box = lambda w: F.struct(w.alias("w"), F.lit(40).alias("s"), (w + 15).alias("e"), F.lit(5).alias("n"))
    asked = t.nation.select(k.alias("subscriber"), mode(k).alias("category"), box(west).alias("box"), F.when(known, box(west - 5)).alias("last_box"), F.when(known, F.when(k % 3 == 0, 9).otherwise(10)).alias("last_ts"))
    return operators.pushed(tiles, asked).select("subscriber", F.col("body").alias("event_id"), "replace_all")
