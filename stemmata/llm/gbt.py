"""Histogram gradient-boosted trees for two classes, in numpy; trained trees are flat arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """All trees' nodes one after another. A leaf's children are itself, so a walk of ``depth`` steps ends in it."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``: every row walks every tree at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 20) -> Trees:
    """Fit log loss. With no rows, or one class, there are no trees: only the prior, 1.0 with no rows."""
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1 - 1e-9
    base = float(np.log(prior / (1 - prior)))
    nodes: list[list[np.ndarray]] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # x <= cut k: bin <= k
        offset = np.arange(x.shape[1]) * bins
        score = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            feature, threshold, left, right, value = [0], [np.inf], [0], [0], [0.0]
            where = np.zeros(len(y), np.int64)
            open_nodes = [0]
            for _ in range(depth):
                nxt: list[int] = []
                for node in open_nodes:
                    rows = np.flatnonzero(where == node)
                    at = (binned[rows] + offset).ravel()
                    size = x.shape[1] * bins
                    g, h, c = (np.bincount(at, w, size).reshape(-1, bins).cumsum(1) for w in (np.repeat(grad[rows], x.shape[1]), np.repeat(hess[rows], x.shape[1]), None))
                    gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                    gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
                    gain[(c < least) | (ct - c < least)] = -np.inf
                    best = int(np.argmax(gain))
                    f, b = divmod(best, bins)
                    if not gain.flat[best] > 1e-6:
                        continue
                    k = len(feature)
                    feature[node], threshold[node], left[node], right[node] = f, cuts[f][b], k, k + 1
                    go = binned[rows, f] <= b
                    for child, own in ((k, rows[go]), (k + 1, rows[~go])):
                        where[own] = child
                        feature.append(0)
                        threshold.append(np.inf)
                        left.append(child)
                        right.append(child)
                        value.append(float(-rate * grad[own].sum() / (hess[own].sum() + l2)))
                        nxt.append(child)
                open_nodes = nxt
            score += np.array(value)[where]
            if len(feature) == 1:
                break
            nodes.append([np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)])
    sizes = np.cumsum([0, *(len(n[0]) for n in nodes)])
    shift = [n[:2] + [n[2] + s, n[3] + s, n[4]] for n, s in zip(nodes, sizes)]
    cat = lambda k, t: np.concatenate([n[k] for n in shift]).astype(t) if shift else np.zeros(0, t)
    return Trees(cat(0, np.int32), cat(1, np.float64), cat(2, np.int32), cat(3, np.int32), cat(4, np.float64), sizes[:-1].astype(np.int32), depth, base)
