"""Alert texts and what they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.clock import twelve_to_twentyfour
from tramline.functions.text import html_decoded, language_of

BOILERPLATE = [r"(?i)\s*for more information,? (?:please )?visit \S+", r"(?i)\s*this service change affects one or more accessible stations\.?", r"(?i)\s*note: real-time tracking on \S+ may be inaccurate[^.]*\.?"]
CAUSES = {"strike": 4, "accident": 6, "holiday": 7, "weather": 8, "maintenance": 9, "construction": 10, "police": 11, "medical": 12}
EFFECTS = {"no service": 1, "cancel": 1, "reduced": 2, "delay": 3, "detour": 4, "additional": 5, "modified": 6, "stop moved": 9, "closed": 1}


def cleaned(text: Column) -> Column:
    """Decoded, without boilerplate, times in 24-hour form, white space joined. [D21]"""
    text = html_decoded(text)
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(F.regexp_replace(twelve_to_twentyfour(text), r"\s+", " "))


def processed(alerts: DataFrame) -> DataFrame:
    """header and description cleaned, a description that repeats the header dropped, ``language`` guessed. [D21, F15]"""
    header, description = cleaned(F.col("header")), cleaned(F.col("description"))
    out = alerts.withColumn("header", header).withColumn("description", description)
    out = out.withColumn("description", F.when(F.col("description") != F.col("header"), F.col("description")))
    return out.withColumn("language", language_of(F.concat_ws(" ", "header", "description")))


def by_entity(alerts: DataFrame) -> DataFrame:
    """alert_id and each route_id, stop_id, trip_id that it informs of: the index for all look-ups. [D21, D22]"""
    return alerts.select("alert_id", F.explode("informed_entity").alias("e")).select("alert_id", "e.route_id", "e.stop_id", "e.trip_id").distinct()


def keyword_code(text: Column, codes: dict[str, int], default: int) -> Column:
    """The code of the first keyword that a text holds. [D46]"""
    out = F.lit(default)
    for word, code in reversed(list(codes.items())):
        out = F.when(F.contains(F.lower(text), F.lit(word)), code).otherwise(out)
    return out
