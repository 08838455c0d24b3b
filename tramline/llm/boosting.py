"""Gradient boosted trees for a log-loss, small enough to be written out as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Trees are nested tuples (feature, cut, left, right) with numbers as leaves; left where value <= cut."""

    names: list[str]
    bias: float
    trees: list

    @classmethod
    def fit(cls, values: np.ndarray, labels: np.ndarray, names: list[str], *, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0) -> BoostedTrees:
        labels = np.asarray(labels, float)
        prior = (labels.sum() + 0.5) / (len(labels) + 1)
        model = cls(names, float(np.log(prior / (1 - prior))), [])
        raw = np.full(len(labels), model.bias)
        for _ in range(rounds if len(labels) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree = _grow(values, p - labels, p * (1 - p), depth, rate, least, ridge)
            if not isinstance(tree, tuple):
                break
            model.trees.append(tree)
            raw += _apply(tree, values)
        return model

    def score(self, values: np.ndarray) -> np.ndarray:
        raw = self.bias + sum((_apply(t, values) for t in self.trees), np.zeros(len(values)))
        return 1 / (1 + np.exp(-raw))

    def sql(self, prefix: str = "") -> str:
        """The score as a SQL expression over columns (or fields behind ``prefix``) of the features' names."""

        def of(node) -> str:
            if not isinstance(node, tuple):
                return f"{node!r}D"
            feature, cut, left, right = node
            return f"CASE WHEN {prefix}{self.names[feature]} <= {cut!r} THEN {of(left)} ELSE {of(right)} END"

        return f"1D / (1D + exp(-({' + '.join([f'{self.bias!r}D', *map(of, self.trees)])})))"


def _apply(node, values: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(values), node)
    feature, cut, left, right = node
    return np.where(values[:, feature] <= cut, _apply(left, values), _apply(right, values))


def _grow(values: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, rate: float, least: int, ridge: float):
    def gain(g, h):
        return g * g / (h + ridge)

    total, best = gain(slope.sum(), curve.sum()), (1e-6, None, None)
    for feature in range(values.shape[1] if depth else 0):
        order = np.argsort(values[:, feature], kind="stable")
        column = values[order, feature]
        g, h = np.cumsum(slope[order]), np.cumsum(curve[order])
        at = np.flatnonzero(np.diff(column) > 0)
        at = at[(at + 1 >= least) & (len(column) - at - 1 >= least)]
        if len(at):
            gains = gain(g[at], h[at]) + gain(g[-1] - g[at], h[-1] - h[at]) - total
            k = int(gains.argmax())
            if gains[k] > best[0]:
                best = (gains[k], feature, float((column[at[k]] + column[at[k] + 1]) / 2))
    if best[1] is None:
        return float(-rate * slope.sum() / (curve.sum() + ridge))
    left = values[:, best[1]] <= best[2]
    return (best[1], best[2], *(_grow(values[m], slope[m], curve[m], depth - 1, rate, least, ridge) for m in (left, ~left)))
