"""Factorisation machine over binary features: fit on a bounded sample, score in linear time.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>), the pairs by the identity
sum over pairs <v_i, v_j> = ((sum v_i)^2 - sum v_i^2) / 2, per factor, over the features that a row has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most, the first by a hash of their id.
SAMPLE_ROWS = 20_000
#: Hashed features that a model keeps at most, by information gain on the sample; and in how many rows one must be.
FEATURES = 4_096
MIN_ROWS = 5


@dataclass
class FactorizationMachine:
    buckets: np.ndarray  # sorted hash buckets of the kept features
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, *, rank: int = 8, epochs: int = 8, rate: float = 0.1, decay: float = 1e-5, batch: int = 256, seed: int = 7, features: int = FEATURES, min_rows: int = MIN_ROWS, positive_weight: float = 1.0) -> FactorizationMachine:
        """``rows``: the buckets that each row has. One class only (or no rows) gives a constant score.

        ``positive_weight``: how many negative rows a positive one weighs up.
        """
        labels = np.asarray(labels, float)
        n, positive = len(labels), float(labels.sum())
        prior = (positive + 0.5) / (n + 1) if n else 0.5
        empty = cls(np.empty(0, np.int64), float(np.log(prior / (1 - prior))), np.empty(0), np.empty((0, rank)))
        if not n or positive in (0, n):
            return empty
        rows = [np.unique(r) for r in rows]
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        buckets, inverse = np.unique(flat, return_inverse=True)
        count = np.bincount(inverse, minlength=len(buckets)).astype(float)
        hits = np.bincount(inverse, weights=np.repeat(labels, sizes), minlength=len(buckets))

        def entropy(k: np.ndarray, of: np.ndarray) -> np.ndarray:
            p = np.clip(k / np.maximum(of, 1), 1e-12, 1 - 1e-12)
            return of * -(p * np.log(p) + (1 - p) * np.log(1 - p))

        gain = entropy(np.array(positive), np.array(float(n))) - entropy(hits, count) - entropy(positive - hits, n - count)
        gain[count < min_rows] = -1
        kept = np.sort(np.argsort(-gain, kind="stable")[: min(features, int((gain > 0).sum()))])
        if not len(kept):
            return empty
        column = np.full(len(buckets), -1)
        column[kept] = np.arange(len(kept))
        columns = column[inverse]
        own = [c[c >= 0] for c in np.split(columns, np.cumsum(sizes)[:-1])]

        rng = np.random.default_rng(seed)
        model = cls(buckets[kept], empty.bias, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), rank)))
        squares = [np.full(1, 1e-6), np.full(len(kept), 1e-6), np.full((len(kept), rank), 1e-6)]
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                at = order[i : i + batch]
                size = np.array([len(own[j]) for j in at])
                cols = np.concatenate([own[j] for j in at])
                row = np.repeat(np.arange(len(at)), size)
                sums = np.zeros((len(at), rank))
                taken = model.factors[cols]
                np.add.at(sums, row, taken)
                pairs = np.bincount(row, weights=(taken * (sums[row] - taken)).sum(1) / 2, minlength=len(at))
                raw = model.bias + np.bincount(row, weights=model.linear[cols], minlength=len(at)) + pairs
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[at]) / len(at)
                error *= np.where(labels[at] > 0, positive_weight, 1.0)
                slope = error[row]
                g_linear = np.bincount(cols, weights=slope, minlength=len(kept)) + decay * model.linear
                g_factors = decay * model.factors
                np.add.at(g_factors, cols, slope[:, None] * (sums[row] - taken))
                for k, (value, g) in enumerate(((None, np.array([error.sum()])), (model.linear, g_linear), (model.factors, g_factors))):
                    squares[k] += g * g
                    step = rate * g / np.sqrt(squares[k])
                    if value is None:
                        model.bias -= float(step[0])
                    else:
                        value -= step
        return model

    def score(self, columns: np.ndarray) -> float:
        """Of a row with these kept features (distinct columns)."""
        taken = self.factors[columns]
        raw = self.bias + self.linear[columns].sum() + ((taken.sum(0) ** 2).sum() - (taken**2).sum()) / 2
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))

    def columns(self, found: np.ndarray) -> np.ndarray:
        """Kept features among these buckets."""
        if not len(self.buckets):
            return np.empty(0, int)
        at = np.searchsorted(self.buckets, found).clip(max=len(self.buckets) - 1)
        return np.unique(at[self.buckets[at] == found])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, *, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents that aren't held out; broadcasts only their ids and labels.

    Labels other than 0 and 1 and null ids are passed over; of repeated labels of an id the least counts.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label")).where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1))
    own = own.groupBy("__id").agg(F.min("__label").alias("__label")).where(~held_out).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    return docs.join(F.broadcast(own), F.col(f"`{id_col}`") == F.col("__id"))


def fit_on(sample: DataFrame, inputs: list[str], featurise: Callable[..., list[int]], **options) -> FactorizationMachine:
    """Features are made on the executors; what reaches the driver is the bounded sample's bucket lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *values, label = (c.to_pylist() for c in batch.columns)
            found = [featurise(*v) for v in zip(*values, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["label", "buckets"])

    table = sample.select(*inputs, "__label").mapInArrow(run, "label int, buckets array<int>").toArrow().combine_chunks()
    labels = table.column("label").to_numpy()
    lists = table.column("buckets").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    rows = np.split(flat, ends[:-1]) if len(ends) else []
    order = sorted(range(len(rows)), key=lambda i: (labels[i], rows[i].tobytes()))  # the fit doesn't depend on how rows were dealt out
    return FactorizationMachine.fit([rows[i] for i in order], labels[order], **options)


def score_with(docs: DataFrame, model: FactorizationMachine, id_col: str, inputs: list[str], featurise: Callable[..., list[int]]) -> DataFrame:
    """``id_col`` and ``score`` of every row; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *values = batch.columns
            scores = [model.score(model.columns(np.array(featurise(*v), np.int64))) for v in zip(*(c.to_pylist() for c in values), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], [id_col, "score"])

    return docs.select(f"`{id_col}`", *inputs).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")
