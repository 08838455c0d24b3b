import numpy as np
import pytest
from llm.conftest import ODD_TEXTS, with_clashes
from pyspark.sql import functions as F

from tramline.llm import quality, toxicity
from tramline.llm.factorization import FactorizationMachine

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    good = np.array(labels) == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_the_identity_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = FactorizationMachine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    at = [0, 2, 3, 7]
    raw = 0.3 + sum(model.linear[i] for i in at) + sum(model.factors[i] @ model.factors[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert model.score(np.array(at)) == pytest.approx(1 / (1 + np.exp(-raw)))


def test_a_pair_without_single_effects_is_learnt():
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(3000)]
    labels = np.array([(0 in r) == (1 in r) for r in rows], float)
    model = FactorizationMachine.fit(rows, labels, epochs=60, features=6, min_rows=1, decay=0)
    assert np.mean([(model.score(model.columns(r)) >= 0.5) == y for r, y in zip(rows, labels, strict=True)]) > 0.9


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op6_quality, "quality", 0.95), (toxicity.op7_toxicity, "toxic", 0.95)])
def test_held_out_rows_are_ranked_well(spark, query, label, least):
    """The larger tables: the smaller ones hold back six toxic rows."""
    rows = query(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out").select("score", label).collect()
    assert auc([r[0] for r in rows], [r[1] for r in rows]) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_cases(spark, module):
    fit, score, label = (quality.fit_quality, quality.score_quality, "quality") if module is quality else (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic")
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "x", 1), (1, "", -5)], "doc_id long, text string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(1, 0), (None, 1), (3, None), (4, 7)], f"doc_id long, {label} int")
    for own in (labels, labels.limit(0), labels.where(f"{label} = 0")):
        got = score(with_clashes(docs).drop("score"), fit(docs, own))
        assert got.columns == ["doc_id", "score"] and got.count() == docs.count() and got.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_keep_good_drops_what_is_scored_low(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    low = {r.doc_id for r in quality.op6_quality(spark, SF).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - low and low
    assert quality.keep_good(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")), labels).count() == 3
