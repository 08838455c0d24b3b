"""Toxicity: a factorisation machine over hashed words and word beginnings, with their pairwise interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import factorization as fm
from tramline.llm.shared import read_table
from tramline.llm.text_features import word_buckets

OPTIONS = {"features": 512, "min_rows": 3, "epochs": 12, "positive_weight": 4.0}
INPUTS = ["text"]
THRESHOLD = 0.5


def featurise(text: str | None) -> list[int]:
    return sorted(word_buckets(text or ""))


def held_out(ident: Column) -> Column:
    return F.crc32(ident.cast("string")) % 5 == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label: str = "toxic", sample_rows: int = fm.SAMPLE_ROWS, **options) -> fm.FactorizationMachine:
    """Fit on at most ``sample_rows`` labelled rows that aren't held out; see ``factorization.labelled_sample``."""
    sample = fm.labelled_sample(docs, labels, label, held_out(F.col("__id")), id_col=id_col, rows=sample_rows)
    return fm.fit_on(sample, INPUTS, featurise, **(OPTIONS | options))


def score_toxicity(docs: DataFrame, model: fm.FactorizationMachine, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of each row, from the whole ``text`` only.

    Null texts count as empty and get a score too; repeated rows are scored alike; an empty table gives an empty
    table; other columns are neither read nor kept. The order of words plays no part.
    """
    return fm.score_with(docs, model, id_col, INPUTS, featurise)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
