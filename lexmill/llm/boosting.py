"""Gradient-boosted trees for two classes on small numeric matrices: log loss, quantile bins, trees of fixed depth."""

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """``feature`` and ``limit`` have the inner nodes of each tree level by level, ``value`` its leaves."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out = np.full(len(rows), self.start)
        index = np.arange(len(rows))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(int(np.log2(len(value)))):
                at = 2 * at + 1 + (rows[index, feature[at]] > limit[at])
            out += value[at - len(feature)]
        return out


def fit_trees(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, *, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Fit by second-order boosting; without both classes the result is a constant."""
    n, width = rows.shape
    weights = np.ones(n) if weights is None else weights
    share = np.clip((weights * labels).sum() / max(weights.sum(), 1e-9), 1e-3, 1 - 1e-3) if n else 0.5
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    features, limits, values = [], [], []
    if n and 0 < labels.sum() < n:
        edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(edges[j], rows[:, j], "left") for j in range(width)], axis=1)
        score = np.full(n, start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weights * (labels - p), weights * p * (1 - p)
            at = np.zeros(n, np.int64)
            feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for node in range(inner):
                own = at == node
                if own.sum() >= 4:
                    best = 1e-6
                    base = g[own].sum() ** 2 / (h[own].sum() + ridge)
                    for j in range(width):
                        if not len(edges[j]):
                            continue
                        gl = np.cumsum(np.bincount(binned[own, j], g[own], bins + 1))[: len(edges[j])]
                        hl = np.cumsum(np.bincount(binned[own, j], h[own], bins + 1))[: len(edges[j])]
                        gain = gl**2 / (hl + ridge) + (g[own].sum() - gl) ** 2 / (h[own].sum() - hl + ridge) - base
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, feature[node], limit[node] = gain[k], j, edges[j][k]
                at[own] = 2 * node + 1 + (rows[own, feature[node]] > limit[node])
            leaf = at - inner
            value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            score += value[leaf]
            features.append(feature)
            limits.append(limit)
            values.append(value)
    return Trees(start, np.array(features, np.int64).reshape(-1, inner), np.array(limits).reshape(-1, inner), np.array(values).reshape(-1, inner + 1))
