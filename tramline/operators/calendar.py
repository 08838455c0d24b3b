"""Service calendars: which services run on which days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.clock import iso_day, service_midnight

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def weekday_mask(*flags: Column) -> Column:
    """Monday is bit 0."""
    return sum((F.coalesce(flag.cast("int"), F.lit(0)) * (1 << i) for i, flag in enumerate(flags)), F.lit(0))


def service_days(calendar: DataFrame, exceptions: DataFrame, keys: tuple[str, ...] = ("service_id",)) -> DataFrame:
    """``keys`` and ``date`` of each day that a service runs. [D1, J10, P12]

    ``calendar``: keys, mask (weekday bits), start_date, end_date; ``exceptions``: keys, date, exception_type (1 adds,
    2 removes and wins over 1; other types are ignored). Either side may lack a service; a null mask or date runs on no
    day. A service's calendar rows and exceptions meet as they are and become days only there, so days are neither
    moved nor hashed.
    """
    usual = calendar.where("start_date <= end_date AND mask > 0").select(*keys, F.lit(0).alias("kind"), F.col("mask").cast("long").alias("mask"), F.col("start_date").cast("date").alias("a"), F.col("end_date").cast("date").alias("b"))
    special = exceptions.where("exception_type IN (1, 2) AND date IS NOT NULL").select(*keys, F.col("exception_type").cast("int").alias("kind"), F.lit(0).cast("long").alias("mask"), F.col("date").cast("date").alias("a"), F.col("date").cast("date").alias("b"))
    rows = usual.unionByName(special).groupBy(*keys).agg(F.collect_set(F.struct("kind", "mask", "a", "b")).alias("__rows"))
    of = lambda kind: F.filter("__rows", lambda r: r["kind"] == kind)
    runs = F.flatten(F.transform(of(0), lambda r: F.filter(F.sequence(r["a"], r["b"]), lambda d: F.pmod(F.floor(r["mask"] / F.pow(F.lit(2.0), F.weekday(d))), F.lit(2)) == 1)))
    dates = lambda kind: F.transform(of(kind), lambda r: r["a"])
    return rows.select(*keys, F.explode(F.array_except(F.concat(runs, dates(1)), dates(2))).alias("date"))


def is_active(date: Column, mask: Column, start: Column, end: Column, added: Column, removed: Column) -> Column:
    """The predicate for one date; ``added`` and ``removed`` are arrays of dates. [D1, G10]"""
    usual = date.between(start, end) & (F.pmod(F.floor(mask / F.pow(F.lit(2), iso_day(date) - 1)), F.lit(2)) == 1)
    return F.coalesce((usual | F.array_contains(added, date)) & ~F.array_contains(removed, date), F.lit(False))


def optimal_calendar(days: DataFrame, keys: tuple[str, ...] = ("service_id",)) -> DataFrame:
    """Fewest exceptions: ``keys``, mask, start_date, end_date, n_added, n_removed. [A12]

    A weekday is on where it runs on more than half of its days between the first and last date. The number of
    exceptions is a sum over weekdays, so the best of the 128 masks is found without trying them; a tie leaves it off,
    which is the lower mask.
    """
    span = days.groupBy(*keys).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), *[F.count_if(F.weekday("date") == i).alias(f"n{i}") for i in range(7)])

    def total(i: int) -> Column:
        first = F.pmod(F.lit(i) - F.weekday("start_date"), F.lit(7))
        return F.greatest(F.lit(0), F.floor((F.datediff("end_date", "start_date") - first) / 7) + 1)

    on = [2 * F.col(f"n{i}") > total(i) for i in range(7)]
    return span.select(
        *keys,
        sum((F.when(on[i], 1 << i).otherwise(0) for i in range(7)), F.lit(0)).cast("int").alias("mask"),
        "start_date",
        "end_date",
        sum((F.when(on[i], 0).otherwise(F.col(f"n{i}")) for i in range(7)), F.lit(0)).cast("long").alias("n_added"),
        sum((F.when(on[i], total(i) - F.col(f"n{i}")).otherwise(0) for i in range(7)), F.lit(0)).cast("long").alias("n_removed"),
    )


def equivalent_services(days: DataFrame, key: str = "service_id") -> DataFrame:
    """``key`` and ``canonical``: the least id of the services that run on the same days. [A11]"""
    sets = days.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("date")), ",").alias("dates")).select(key, F.sha2("dates", 256).alias("dates"))
    return sets.join(sets.groupBy("dates").agg(F.min(key).alias("canonical")), "dates").select(key, "canonical")


def feed_span(days: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """First and last date. [A13]"""
    return days.groupBy(*keys).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def service_instants(days: DataFrame, zone: Column | str) -> DataFrame:
    """``days`` with ``midnight``: the epoch second that the day's times count from. [D2, F6]"""
    return days.withColumn("midnight", service_midnight(F.col("date"), zone))


def services_between(days: DataFrame, zone: Column | str, start: int, end: int, longest: int = 172_800) -> DataFrame:
    """Days whose times of up to ``longest`` seconds can fall between two epoch seconds; prunes dates before computing instants. [D2]"""
    near = days.where(F.col("date").between(F.to_date(F.timestamp_seconds(F.lit(start - longest - 86_400))), F.to_date(F.timestamp_seconds(F.lit(end + 86_400)))))
    return service_instants(near, zone).where((F.col("midnight") <= end) & (F.col("midnight") + longest >= start))
