"""Timetable clock: seconds of a service day, which may pass 24 hours, and the instants they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(clock: Column, strict: bool = True) -> Column:
    """'HH:MM:SS' to seconds (hours may exceed 24); null if malformed. Not ``strict``: minutes and seconds may exceed 59. [F1]"""
    parts = F.split(F.trim(clock), ":")
    pattern = r"^[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]$" if strict else r"^[0-9]{1,3}:[0-9]{1,2}:[0-9]{1,2}$"
    hour, minute, second = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return F.when(F.trim(clock).rlike(pattern), hour * 3600 + minute * 60 + second)


def normalised_clock(clock: Column) -> Column:
    """'H:MM' and 'HH:MM' get seconds, one-digit hours a zero. [S2]"""
    clock = F.trim(clock)
    clock = F.when(clock.rlike(r"^[0-9]{1,3}:[0-9]{2}$"), F.concat(clock, F.lit(":00"))).otherwise(clock)
    return F.when(clock.rlike(r"^[0-9]:"), F.concat(F.lit("0"), clock)).otherwise(clock)


def clock_of(seconds: Column) -> Column:
    """Seconds to 'HH:MM:SS'; hours may exceed 24. [F2]"""
    whole = seconds.cast("int")
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60))


def compact_date(text: Column) -> Column:
    """'yyyyMMdd' to a date; null if it isn't one. [F4]"""
    return F.when(F.trim(text).rlike("^[0-9]{8}$"), F.try_to_date(F.trim(text), "yyyyMMdd"))


def epoch_of_rfc3339(text: Column) -> Column:
    """An RFC 3339 instant to epoch seconds. [F5]"""
    return F.unix_timestamp(F.try_to_timestamp(text))


def wall_seconds(ntz: Column) -> Column:
    """Seconds from 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), ntz)


def service_midnight(date: Column, zone: Column | str) -> Column:
    """The instant that a service day's seconds count from: local noon less 12 hours, which daylight saving can't
    move off. As epoch seconds. [F6]"""
    noon = F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), F.lit(12), F.lit(0), F.lit(0))
    return wall_seconds(F.convert_timezone(zone if isinstance(zone, Column) else F.lit(zone), F.lit("UTC"), noon)) - 43_200


def local_epoch(local: Column, zone: Column | str) -> Column:
    """A local wall time (timestamp_ntz) to epoch seconds: the earlier of two instants, null in a gap. [F7]"""
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    utc = F.convert_timezone(zone, F.lit("UTC"), local)
    return F.when(F.convert_timezone(F.lit("UTC"), zone, utc) == local, wall_seconds(utc))


def twelve_to_twentyfour(text: Column) -> Column:
    """Times like '7:05 pm' inside a text in 24-hour form. [F3]

    Each hour has its own replacement, so the whole text stays one SQL expression; texts without such a time skip them.
    """
    given = text
    for hour in range(1, 13):
        for half, base in (("a", 0), ("p", 12)):
            to = f"{hour % 12 + base:02d}"
            text = F.regexp_replace(text, rf"(?i)(?<![0-9:])0?{hour}:([0-5][0-9]) ?{half}\.?m\b\.?", f"{to}:$1")
            text = F.regexp_replace(text, rf"(?i)(?<![0-9:])0?{hour} ?{half}\.?m\b\.?", f"{to}:00")
    return F.when(given.rlike(r"(?i)[0-9] ?[ap]\.?m\b"), text).otherwise(given)


def iso_day(date: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(date) + 1
