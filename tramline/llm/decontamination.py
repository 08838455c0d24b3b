"""Benchmark decontamination: find short test items inside long documents.

Size-partitioned MinHash containment search. Items fall into partitions by the order of their number of distinct
shingles; each partition has its own sketch length. An item's sketch is its k least shingle hashes (bottom-k MinHash),
those that few items have going first, so that stock phrases are no keys. A document that holds at least ``threshold`` of
an item's n shingles lacks at most ``n - ceil(threshold * n)`` of them, so it has all but that many of the sketch's hashes;
k is the largest such number of the partition and ``SPARE`` more. Candidates with too few hits fall; the rest is verified
on the shingles themselves. Documents give all their hashes, not a sketch: one of a long document would lose short
items, whose Jaccard similarity with it is near 0. So the search loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.shared import materialise, read_table

WORDS = 5
THRESHOLD = 0.8
#: Hashes of a sketch beyond those that must be there for one of them to be in any document that holds the item.
SPARE = 2
#: Size up to which a table about the items is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def small(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if its own rows are found to fit in ``BROADCAST_BYTES`` (strings by their length,
    16 bytes more for each column)."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(0) for c, t in table.dtypes), F.lit(0))
    found = table.agg(F.sum(size).alias("s"), F.count("*").alias("n")).first()
    return F.broadcast(table) if (found.s or 0) + 16 * len(table.columns) * found.n <= BROADCAST_BYTES else table


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all word runs of ``size``, repeats included; null where there are too few words."""
    starts = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.when(F.size(words) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size))))


def shingles(words: Column, size: int) -> Column:
    """The word runs of ``size`` themselves, space-joined, without repeats."""
    starts = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.when(F.size(words) >= size, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))))


def contained_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (``doc_id``, ``item_id``) whose document holds at least ``threshold`` of the item's shingles.

    Adds ``n_shingles`` (distinct shingles of the item), ``n_shared`` and ``containment``. Edge cases: items and
    documents of fewer than ``words`` words have no shingle and match nothing; null texts count as empty; rows
    with null ids are not matched; repeated ids count as one text each with all its rows' shingles; other columns
    are not read. No partner is capped.

    Plan: items are few against documents; tables about them are broadcast only where their own size is found to be
    small, otherwise joined by hash. Only sketch hits leave the map side; only documents with candidates are shingled
    again, and of their shingles only those of some item are shuffled, to be met by (document, shingle), so a phrase that
    many items and many documents share makes no product of them.
    """
    item_words = words_of(F.col(f"`{text_col}`"))
    full = (
        items.where(F.col(f"`{item_id}`").isNotNull())
        .select(F.col(f"`{item_id}`").alias("item"), item_words.alias("w"))
        .select("item", F.explode(shingles(F.col("w"), words)).alias("s"))
        .distinct()
    )
    full = materialise(full.select("item", "s", F.xxhash64(F.split("s", " ")).alias("h")), "item-shingles")
    sketch = materialise(sketches(full, threshold), "sketches")

    texts = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc"), words_of(F.col(f"`{text_col}`")).alias("w"))
    probes = texts.select("doc", F.explode(shingle_hashes(F.col("w"), words)).alias("h"))
    hits = probes.join(small(sketch.select("h", "item", "n", "least")), "h").groupBy("doc", "item", "n", "least").agg(F.count_distinct("h").alias("hits"))
    hits = materialise(hits.where("hits >= least").select("doc", "item", "n"), "candidates")
    suspects = texts.join(hits.select("doc").distinct(), "doc", "left_semi").select("doc", F.explode(shingles(F.col("w"), words)).alias("s"))
    held = suspects.join(small(full.select("s").distinct()), "s", "left_semi").distinct()
    wanted = hits.join(small(full.select("item", "s")), "item")
    found = held.join(wanted, ["doc", "s"]).groupBy("doc", "item", "n").agg(F.count("*").alias("n_shared"))
    return found.where(F.col("n_shared") >= F.col("n") * F.lit(threshold) - 1e-9).select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")
    )


def sketches(full: DataFrame, threshold: float) -> DataFrame:
    """``part``, ``item``, ``n`` (its shingles), ``h`` of each hash of its sketch, and ``least``: how many of those a
    document that holds the item has. ``full``: item, s, h of the items' distinct shingles."""
    shared = full.join(full.groupBy("h").agg(F.count("*").alias("items")), "h")
    sizes = shared.groupBy("item").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.struct("items", "h"))).alias("hs"))
    lacking = lambda n: n - F.ceil(n * F.lit(threshold) - 1e-9)
    part = F.floor(F.log2("n")).cast("int")
    own = sizes.withColumn("part", part).withColumn("k", F.least(F.size("hs"), lacking(F.pow(F.lit(2), F.col("part") + 1) - 1) + 1 + SPARE).cast("int"))
    return own.select("part", "item", "n", F.greatest(F.lit(1), F.col("k") - lacking(F.col("n"))).cast("int").alias("least"), F.explode(F.slice("hs", 1, F.col("k"))).alias("x")).select("part", "item", "n", "least", "x.h")


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", **options) -> DataFrame:
    """``docs`` without those that hold an item; rows with null ids stay."""
    bad = contained_items(docs, items, doc_id=doc_id, item_id=item_id, **options).select(F.col(doc_id).alias("__dc_id")).distinct()
    bad = materialise(bad, "contaminated")
    return docs.join(bad, F.col(f"`{doc_id}`") == F.col("__dc_id"), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contained_items(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw WHERE len(w) >= 5),
sh AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n FROM sh GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN sh USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n - 1e-9
"""
