"""Line dedup: drop lines that many documents share, keep one holder of each.

All steps are DataFrame expressions: lines are exploded with their position, their normalised key is
hashed to 128 bits, distinct documents are counted per hash, and the text is put together again from
the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.shared import ascii_lower, materialise, read_table

MIN_CHARS = 40
MIN_DOCS = 5
#: Bits of the bitmap that tells which ids may lose lines.
BITS = 1 << 26
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_BLANKS)))


def _bit(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(BITS))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text_col`` rid of shared lines, and ``n_lines`` and ``n_dropped`` (long) added.

    A line's key is the line stripped of ASCII blanks with A-Z lower-cased. Keys of at least ``min_chars``
    code points in at least ``min_docs`` distinct ids lose every line but those of the largest id.

    Edge cases: a null or empty text is one empty line (and comes back as ''). Rows with the same id are one
    document. A row with a null id neither counts nor loses lines. Input columns called ``n_lines`` or
    ``n_dropped`` are replaced; all others pass through. An empty table gives an empty table.

    Plan: one pass over the texts writes (id, position, hash) of the long lines; counting shuffles partial
    sums only; the table of shared hashes is written, so that its join with the lines is a broadcast where
    it is small and otherwise a sort-merge join that adaptive execution can split at a hot line. Only texts of ids
    that may lose lines are shuffled to meet their dropped positions; the others, told by a bitmap of id hashes of a
    fixed size (``BITS``, so 8 MB at most are broadcast), pass on the map side.
    """
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = F.xxhash64(text)
    lines = (
        docs.where(ident.isNotNull())
        .select(ident.alias("id"), row.alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    lines = materialise(lines, "lines")
    shared = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("holder")).where(F.col("n") >= min_docs)
    shared = materialise(shared.drop("n"), "shared-lines")
    dropped = lines.join(shared, ["h1", "h2"]).where(F.col("id") != F.col("holder")).groupBy("id", "row").agg(F.collect_set("pos").alias("drop"))
    dropped = materialise(dropped.select(F.col("id").alias("__ld_id"), F.col("row").alias("__ld_row"), F.col("drop").alias("__ld_drop")), "dropped-lines")

    marks = dropped.select(_bit(F.col("__ld_id")).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("__ld_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("__ld_bits"))
    place = F.bitmap_bit_position(_bit(ident))
    byte = F.conv(F.hex(F.substr("__ld_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.expr("shiftright(__ld_byte, __ld_place) & 1") == 1, F.lit(False))
    marked = docs.join(F.broadcast(marks), F.bitmap_bucket_number(_bit(ident)) == F.col("__ld_bucket"), "left")
    marked = marked.withColumns({"__ld_byte": byte, "__ld_place": F.pmod(place, F.lit(8)).cast("int")})
    own = [F.col(f"`{c}`") for c in docs.columns]
    hit = marked.where(may).select(*own).join(dropped, (ident == F.col("__ld_id")) & (row == F.col("__ld_row")), "left").select(*own, "__ld_drop")
    joined = hit.unionByName(marked.where(~may).select(*own, F.lit(None).cast("array<int>").alias("__ld_drop")))
    parts = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__ld_drop"))
    kept = F.when(F.col("__ld_drop").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    out = joined.select(
        *others,
        kept.alias(text_col),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("__ld_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(*[f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT d.doc_id, d.pos, d.line, (s.k IS NOT NULL AND s.holder <> d.doc_id) AS gone
  FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
