"""Quality classifier: a factorisation machine over hashed words, structure statistics and the recorded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import factorization as fm
from tramline.llm.shared import materialise, read_table
from tramline.llm.text_features import structure_buckets, word_buckets

#: Structure decides most here; few, frequent words keep the machine from learning single documents.
OPTIONS = {"features": 512, "min_rows": 20, "epochs": 10}
INPUTS = ["text", "n_chars"]
THRESHOLD = 0.5


def featurise(text: str | None, n_chars: int | None) -> list[int]:
    text = text or ""
    return sorted(word_buckets(text) | structure_buckets(text, n_chars))


def held_out(ident: Column) -> Column:
    return F.crc32(ident.cast("string")) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label: str = "quality", sample_rows: int = fm.SAMPLE_ROWS, **options) -> fm.FactorizationMachine:
    """Fit on at most ``sample_rows`` labelled rows that aren't held out; see ``factorization.labelled_sample``."""
    sample = fm.labelled_sample(docs, labels, label, held_out(F.col("__id")), id_col=id_col, rows=sample_rows)
    return fm.fit_on(sample, INPUTS, featurise, **(OPTIONS | options))


def score_quality(docs: DataFrame, model: fm.FactorizationMachine, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of each row, from ``text`` and ``n_chars`` only.

    Null texts count as empty and get a score too; a null ``n_chars`` is a feature value of its own; repeated rows
    are scored alike, ties don't arise; an empty table gives an empty table; other columns are neither read nor kept.
    """
    return fm.score_with(docs, model, id_col, INPUTS, featurise)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows scored below ``threshold``. Rows with a null id are kept, as they can't be told apart."""
    scores = score_quality(docs, fit_quality(docs, labels, id_col=id_col), id_col=id_col)
    bad = materialise(scores.where(F.col("score") < threshold).select(F.col(id_col).alias("__q_id")).distinct(), "rejected")
    return docs.join(bad, F.col(f"`{id_col}`") == F.col("__q_id"), "left_anti")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scores = score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
