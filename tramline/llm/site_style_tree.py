"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles (tags with their classes). A node's importance is made of two
entropies over the pages: that of how its elements are made up (which blocks they hold, how much text), and that of
what the blocks below it say. Nodes that look and speak alike everywhere are the site's own and go with all that is
below them. Markup that names itself (nav, advert, comment list) is a prior that only ever takes away: entropy can't
tell readers' comments or a rotating advert from content. An article or main element bounds where content is sought.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.html_blocks import parsed
from tramline.llm.shared import materialise, read_table

#: Pages that must have a style node before it is judged.
MIN_PAGES = 8
#: Importance below which a node goes: one whose text is mostly links, and any other.
LEAST_LINKED, LEAST = 0.6, 0.3
#: Entropy of whole pages below which a host's pages count as one page many times.
SAME_PAGES = 0.1
#: What a node of n blocks is made up of counts for 1 - DAMPING**n, what is said below it for the rest.
DAMPING = 0.8

_PART = pa.struct([("text", pa.string()), ("said", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("nodes", pa.list_(pa.int64()))])
_NODE = pa.struct([("node", pa.int64()), ("makeup", pa.int64()), ("kids", pa.int32()), ("first", pa.bool_())])


def parts_of(html: str) -> tuple[list[dict], list[dict]]:
    """(blocks, nodes) of a page. Every block counts in the tree; ``text`` is null where the markup's prior is against
    it: it names itself as no content, or the page has an article (or main) element and the block is outside it."""
    blocks, nodes = parsed(html)
    scope = next((s for s in ("article", "main") if any(b.scope == s and not b.noise for b in blocks)), "")
    parts = [
        {"text": None if b.noise or scope and b.scope != scope else b.text, "said": xxhash.xxh64_intdigest(b.text.encode("utf-8", "surrogatepass")) >> 1, "chars": len(b.text), "linked": min(b.linked, len(b.text)), "nodes": b.nodes}
        for b in blocks
    ]
    seen: set[int] = set()
    counted = []
    whole = hash(tuple(p["said"] for p in parts)) >> 2  # of whole numbers, so alike in every process
    for n in nodes:
        counted.append({"node": n.node, "makeup": n.makeup if n.node else whole, "kids": n.kids, "first": n.node not in seen})
        seen.add(n.node)
    return parts, counted


def _entropy(counts: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """``keys`` and ``spread``: the entropy of the values counted in ``k``, as a share of the largest possible; 1 for a
    lone one. ``n`` is the sum of counts."""
    both = counts.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("kk"), *sums)
    share = (F.log("n") - F.col("kk") / F.col("n")) / F.log("n")
    return both.withColumn("spread", F.when(F.col("n") > 1, share).otherwise(1.0)).drop("kk")


def importances(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host``, ``node``, ``linked`` (share of its text in links), ``spread`` (entropy of its makeup) and ``importance``
    of the style nodes of at least ``min_pages`` pages. Node 0 is the whole page, made up of all it says. ``pages``:
    host, parts, nodes as ``parts_of`` gives them.

    All is sums by (host, node, value) on the map side, so a host with a third of all pages is no single task.
    """
    blocks = pages.select("host", F.explode("parts").alias("p"))
    said = blocks.groupBy("host", F.coalesce(F.col("p.nodes"), F.array().cast("array<bigint>")).alias("nodes"), "p.said").agg(F.count("*").alias("k"), F.sum("p.chars").alias("chars"), F.sum("p.linked").alias("linked"))
    leaves = _entropy(said, ["host", "nodes"], F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    # a leaf's entropy counts in every node above it, and in the whole page's, number 0
    spoken = leaves.select("host", "n", "spread", "chars", "linked", F.explode(F.concat(F.array(F.lit(0).cast("long")), "nodes")).alias("node"))
    spoken = spoken.groupBy("host", "node").agg((F.sum(F.col("n") * F.col("spread")) / F.sum("n")).alias("content"), (F.sum("linked") / F.sum("chars")).alias("linked"))
    made = pages.select("host", F.explode("nodes").alias("e")).groupBy("host", "e.node", "e.makeup").agg(F.count("*").alias("k"), F.sum("e.kids").alias("kids"), F.sum(F.col("e.first").cast("long")).alias("pages"))
    made = _entropy(made, ["host", "node"], F.sum("kids").alias("kids"), F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages)
    weight = 1 - F.pow(F.lit(DAMPING), F.col("kids") / F.col("n"))
    return made.join(spoken, ["host", "node"]).select("host", "node", "linked", "spread", (weight * F.col("spread") + (1 - weight) * F.col("content")).alias("importance"))


def low_nodes(importance: DataFrame, least: float = LEAST, least_linked: float = LEAST_LINKED) -> DataFrame:
    """``host`` and ``low``: its nodes that go. Hosts whose pages hardly differ (one page many times) have none, as
    there all would go."""
    goes = (F.col("node") != 0) & (F.col("importance") < F.when(F.col("linked") > 0.5, least_linked).otherwise(least))
    same = F.coalesce(F.max(F.when(F.col("node") == 0, F.col("spread"))) < SAME_PAGES, F.lit(False))
    return importance.groupBy("host").agg(F.collect_list(F.when(goes, F.col("node"))).alias("low"), same.alias("same")).where((F.size("low") > 0) & ~F.col("same")).drop("same")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, least: float = LEAST, least_linked: float = LEAST_LINKED) -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` of every row: content blocks in page order, joined by two line ends.

    A null or empty page gives ''. Null urls form one site. Repeated rows are each extracted and count each in their
    site's tree. Other columns are neither read nor kept; an empty table gives an empty table.

    Plan: each page is parsed once, and its blocks and nodes are written. The trees are counts (see ``importances``);
    the low nodes, gathered by host, are joined back (by broadcast if small, else by a sort-merge join that can be split
    at a hot host).
    """
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                found = [parts_of(h or "") for h in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.list_(_PART)), pa.array([f[1] for f in found], pa.list_(_NODE))], ["id", "url", "host", "parts", "nodes"])

    schema = f"id {kind}, url string, host string, parts array<struct<text:string,said:long,chars:long,linked:long,nodes:array<long>>>, nodes array<struct<node:long,makeup:long,kids:int,first:boolean>>"
    read = materialise(rows.select("id", "url", host.alias("host"), "html").mapInArrow(parse, schema), "page-parts")
    low = materialise(low_nodes(importances(read, min_pages), least, least_linked), "low-nodes")
    kept = F.filter("parts", lambda p: p["text"].isNotNull() & (F.col("low").isNull() | ~F.coalesce(F.arrays_overlap("low", p["nodes"]), F.lit(False))))
    text = F.array_join(F.transform(kept, lambda p: p["text"]), "\n\n")
    return read.join(low, "host", "left").select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
