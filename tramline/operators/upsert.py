"""Writes that merge: new rows over old ones, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Old rows with new ones over them; of several new rows for a key the last in ``order`` wins. [K2]"""
    rank = Window.partitionBy(*keys).orderBy(F.desc("__new"), *[F.desc(o) for o in order])
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r", "__new")


def upserted_sets(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per key with the sorted distinct non-null elements of both sides' arrays. [K3, A15]"""
    both = old.select(*keys, column).unionByName(new.select(*keys, column)).select(*keys, F.explode_outer(column).alias("__e"))
    return both.groupBy(*keys).agg(F.sort_array(F.collect_set("__e")).alias(column))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key isn't there yet, one per key. [K4]"""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def updated(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with non-null changes put in. [K5]"""
    sets = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(sets, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def without_attempt(tables: dict[str, DataFrame], feed: str, attempt: str) -> dict[str, DataFrame]:
    """All tables without one attempt's rows. [K6]"""
    gone = (F.col("onestop_feed_id") == feed) & (F.col("attempt_id") == attempt)
    return {name: df.where(~F.coalesce(gone, F.lit(False))) for name, df in tables.items()}
