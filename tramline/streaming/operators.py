"""Streaming forms: what is new, what is latest, what has gone, in windows and for subscribers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows that a function hands back at a time.
PART_ROWS = 50_000


def changed_only(stream: DataFrame, keys: list[str], content: str, order: str) -> DataFrame:
    """Rows whose ``content`` differs from the last one of their key; state is one hash a key. [T1, T7]"""
    hashed = stream.withColumn("__hash", F.sha2(F.col(content).cast("binary"), 256))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        before = state.get[0] if state.exists else None
        new = rows[rows["__hash"] != rows["__hash"].shift(fill_value=before if before is not None else "")]
        state.update((rows["__hash"].iloc[-1],))
        yield new.drop(columns="__hash")

    return hashed.groupBy(*keys).applyInPandasWithState(run, stream.schema, "hash string", "append", GroupStateTimeout.NoTimeout)


def header_gate(stream: DataFrame, feed: str = "feed_id", poll: str = "fetched_ms", kind: str = "kind", header: str = "header_ts", always: tuple[str, ...] = ()) -> DataFrame:
    """All kinds of a poll if any of them is new. [T2]

    New: the header's time is null or 0, or isn't the last one saved for (feed, kind). Older but different times are new
    too. The last time is saved even where nothing is new; feeds in ``always`` are always new. A batch's polls are told
    apart by whole columns, with no frame for each.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames), ignore_index=True)
        polls = pd.factorize(rows[poll], sort=True, use_na_sentinel=False)[0]
        order = np.argsort(polls, kind="stable")
        rows, polls = rows.iloc[order], polls[order]
        times = rows[header].astype("Int64")
        times = times.mask(times == 0)
        codes, kinds = pd.factorize(rows[kind], use_na_sentinel=False)
        new = np.full(len(rows), key[0] in always)
        for code, k in enumerate(kinds):
            at, name = np.flatnonzero(codes == code), None if pd.isna(k) else str(k)
            own = times.iloc[at]
            known = own.ffill()
            before = known.shift()
            if name in saved:
                before = before.fillna(saved[name])
            new[at] |= (own != before).fillna(True).to_numpy(bool)
            if not pd.isna(known.iloc[-1]):
                saved[name] = int(known.iloc[-1])
        state.update((list(saved.keys()), list(saved.values())))
        passes = np.flatnonzero(np.bincount(polls, new)[polls] > 0)
        for first in range(0, len(passes), PART_ROWS):
            yield rows.iloc[passes[first : first + PART_ROWS]]

    return stream.groupBy(feed).applyInPandasWithState(run, stream.schema, "kinds array<string>, times array<long>", "append", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, in update mode; merged on the map side before any shuffle. [T3, T14]"""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("m")).select(*keys, "m.*")


def recent_positions(stream: DataFrame, key: str = "vehicle_id", keep: int = 5, idle_ms: int = 300_000) -> DataFrame:
    """vehicle, its last ``keep`` positions as arrays; forgotten after ``idle_ms`` without a row. [T8, J21]

    A reversal (the last two moves point apart, cosine below -0.5) starts the history anew.
    """

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, lons, lats = (list(x) for x in state.get) if state.exists else ([], [], [])
        for row in pd.concat(list(frames)).sort_values("timestamp").itertuples():
            times, lons, lats = [*times, int(row.timestamp)][-keep:], [*lons, float(row.lon)][-keep:], [*lats, float(row.lat)][-keep:]
            if len(lons) >= 3:
                a, b = (lons[-2] - lons[-3], lats[-2] - lats[-3]), (lons[-1] - lons[-2], lats[-1] - lats[-2])
                size = ((a[0] ** 2 + a[1] ** 2) * (b[0] ** 2 + b[1] ** 2)) ** 0.5
                if size and (a[0] * b[0] + a[1] * b[1]) / size < -0.5:
                    times, lons, lats = times[-1:], lons[-1:], lats[-1:]
        state.update((times, lons, lats))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [name[0]], "times": [times], "lons": [lons], "lats": [lats]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, times array<long>, lons array<double>, lats array<double>", "times array<long>, lons array<double>, lats array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def with_grace(stream: DataFrame, keys: list[str], value: str, order: str, grace_ms: int = 60_000) -> DataFrame:
    """keys, ``value`` and ``gone``: the value of a key's greatest ``order``, and once more with ``gone`` when none came
    for ``grace_ms``. A row that comes late doesn't replace a newer one. [T6]"""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
        else:
            last, at = state.get if state.exists else (None, None)
            for frame in frames:
                top = frame.loc[frame[order].idxmax()]
                if at is None or top[order] >= at:
                    last, at = str(top[value]), int(top[order])
            state.update((last, at))
            state.setTimeoutDuration(grace_ms)
        yield pd.DataFrame({**{k: [v] for k, v in zip(keys, name, strict=True)}, value: [last], "gone": [not state.exists]})

    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{value} string", "gone boolean"])
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, f"{value} string, at long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed(stream: DataFrame, at: str, size: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts in tumbling or sliding windows; rows older than the watermark are dropped. [T5, T9, T10]"""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, at: str, gap: str, keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """[T9]"""
    return stream.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def subscribed(updates: DataFrame, subscriptions: DataFrame, key: str = "chateau") -> DataFrame:
    """Updates for those who asked, by a stream-static join; the registry is read anew each batch. [T11]"""
    return updates.join(subscriptions, key)


def pushed(tiles: DataFrame, requests: DataFrame) -> DataFrame:
    """What a subscriber gets of the tiles in its bounds. [T12, D29]

    ``tiles``: category, x, y, body, feed_ts; ``requests``: subscriber, category, box (west, north, east, south of tiles), last_box, last_ts.
    All tiles where the feed's time has changed, no bounds or no time were known; else those outside the last bounds.
    """
    inside = lambda box: F.col("x").between(F.col(f"{box}.w"), F.col(f"{box}.e")) & F.col("y").between(F.col(f"{box}.n"), F.col(f"{box}.s"))
    whole = F.col("last_box").isNull() | F.col("last_ts").isNull() | ~F.col("feed_ts").eqNullSafe(F.col("last_ts"))
    joined = tiles.join(requests, "category").where(inside("box")).withColumn("replace_all", whole)
    return joined.where(whole | ~inside("last_box")).select("subscriber", "category", "x", "y", "body", "replace_all")


def into(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run a stream into ``batch``, which gets each micro-batch once per id: rebuilds coalesce by themselves. [T4, T13, K2, D23]"""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
