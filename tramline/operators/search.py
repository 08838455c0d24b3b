"""Text search: an inverted index as a table, BM25 by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = ("station", "gare", "bahnhof", "estacion", "estación", "stazione", "駅", "站", "역")
SYNONYMS = {"hbf": "hauptbahnhof"}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def station_tokens(text: Column) -> Column:
    """Tokens without the words that most stations share, with abbreviations written out. [D33]"""
    full = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    words = F.filter(tokens(text), lambda w: ~w.isin(*STOP_WORDS))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(full, w), w))


def postings(documents: DataFrame, ident: str, words: Column) -> DataFrame:
    """term, ``ident``, tf, size (words of the document). [K8]"""
    listed = documents.select(ident, words.alias("__w"))
    return listed.select(ident, F.size("__w").alias("size"), F.explode("__w").alias("term")).groupBy("term", ident, "size").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, ident: str, query: list[str], count: int, mean_size: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``ident`` and ``score`` of documents with any of the query's terms. [D32]

    Only the query's terms are read from the index (a pushed-down filter); their document counts are few rows.
    """
    hits = index.where(F.col("term").isin(query))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (count - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean_size))
    return hits.join(F.broadcast(df), "term").groupBy(ident).agg(F.sum(idf * part).alias("score"))  # a row for each query term


def mode_boost(route_types: Column) -> Column:
    """Rail x 3, metro x 2, tram x 1.5. [D32]"""
    return F.when(F.array_contains(route_types, 2), 3.0).when(F.array_contains(route_types, 1), 2.0).when(F.array_contains(route_types, 0), 1.5).otherwise(1.0)


def nearness_boost(metres: Column, weight: float = 2.0, pivot: float = 20_000) -> Column:
    """1 + weight * pivot / (pivot + distance). [D32]"""
    return 1 + weight * pivot / (pivot + metres)


def top_hits(scored: DataFrame, ident: str, k: int = 100) -> DataFrame:
    """[O3]"""
    return scored.orderBy(F.desc("score"), ident).limit(k)
