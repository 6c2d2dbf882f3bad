"""Confidences that passages of one document are foreign, from their feature vectors: clusterings and a hidden Markov model.

Everything is deterministic: centres start from the points farthest from each other, and of clusters of equal
size the one whose first passage comes last is the smallest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

STAY = np.log(np.array([[0.9368, 0.0632], [0.1406, 0.8594]]))


def whiten(x: np.ndarray) -> np.ndarray:
    """Each column over its deviation; a constant column stays."""
    sd = x.std(axis=0)
    return x / np.where(sd == 0, 1.0, sd)


def _start(x: np.ndarray, k: int) -> np.ndarray:
    """k rows: the farthest from the mean, then always the farthest from those chosen."""
    chosen = [int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen].copy()


def lloyd(x: np.ndarray, k: int, centre: Callable[[np.ndarray], np.ndarray], power: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cluster of each row): assignment by the sum of powers of differences, centres by ``centre``."""
    c = _start(x, k)
    of = np.full(len(x), -1)
    for _ in range(rounds):
        new = np.argmin((np.abs(x[:, None] - c[None]) ** power).sum(axis=2), axis=1)
        if (new == of).all():
            break
        of = new
        for j in range(len(c)):
            if (of == j).any():
                c[j] = centre(x[of == j])
    return c, of


def kmeans(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return lloyd(x, k, lambda rows: rows.mean(axis=0), 2)


def kmedians(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return lloyd(x, k, lambda rows: np.median(rows, axis=0), 1)


def _by_size(of: np.ndarray) -> list[int]:
    """Clusters, the largest first; of equals the one that begins first."""
    first = {int(c): int(np.flatnonzero(of == c)[0]) for c in np.unique(of)}
    return sorted(first, key=lambda c: (-int((of == c).sum()), first[c]))


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=1))


def score_kmeans(x: np.ndarray, k: int = 2) -> np.ndarray:
    """Two clusters: how much nearer the small one is. More: distance between centres, damped near the majority's border."""
    if len(x) < 2:
        return np.zeros(len(x))
    x = whiten(x)
    c, of = kmeans(x, k)
    order = _by_size(of)
    if len(order) < 2:
        return np.zeros(len(x))
    if k == 2:
        own, other = _far(x, c[order[-1]]), _far(x, c[order[0]])
        return np.divide(other, own + other, out=np.zeros(len(x)), where=own + other > 0)
    major = order[0]
    inside = _far(x, c[major])
    edge = int(np.argmax(np.where(of == major, inside, -1)))
    reach = inside[edge]
    mean_gap = _far(c, c[major]).mean()
    out = np.zeros(len(x))
    for i in np.flatnonzero(of != major):
        to_edge = float(np.sqrt(((x[i] - x[edge]) ** 2).sum()))
        if reach > 0 and to_edge > 0 and mean_gap > 0:
            out[i] = (1 - to_edge / reach) * float(np.sqrt(((c[of[i]] - c[major]) ** 2).sum())) / mean_gap
    return out


def score_kmedians(x: np.ndarray, k: int = 2) -> np.ndarray:
    """Distance to the largest cluster's centre over the largest such distance."""
    if not len(x):
        return np.zeros(0)
    c, of = kmedians(x, k)
    d = _far(x, c[_by_size(of)[0]])
    return d / d.max() if d.max() > 0 else d


def score_median_kmeans(x: np.ndarray, k: int = 2) -> np.ndarray:
    """One feature: distance to the median of the largest k-means cluster over the largest such distance."""
    if x.shape[1] != 1:
        raise ValueError("median_kmeans takes one feature")
    if not len(x):
        return np.zeros(0)
    _, of = kmeans(whiten(x), k)
    d = np.abs(x[:, 0] - np.median(x[of == _by_size(of)[0], 0]))
    return d / d.max() if d.max() > 0 else d


def score_agglom(x: np.ndarray, k: int = 2) -> np.ndarray:
    """Single linkage cut to k clusters (a spanning tree without its k - 1 longest edges): 1 in the smallest."""
    n = len(x)
    if n < 2 or k < 2:
        return np.zeros(n)
    near, link, inside, edges = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        d = _far(x, x[at])
        closer = ~inside & (d < near)
        near[closer], link[closer] = d[closer], at
        at = int(np.argmin(np.where(inside, np.inf, near)))
        edges.append((near[at], at, int(link[at])))
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in sorted(edges)[: n - k]:
        root[find(a)] = find(b)
    of = np.array([find(i) for i in range(n)])
    order = _by_size(of)
    return (of == order[-1]).astype(float) if len(order) > 1 else np.zeros(n)


def viterbi(emit: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, float]:
    """The likeliest states for log emissions (n, k), log transitions (k, k) and log beginnings, and their log likelihood."""
    n, k = emit.shape
    if k == 2 and n and np.isfinite(emit).all():
        return _viterbi2(emit.tolist(), move.tolist(), begin.tolist())
    best, back = begin + emit[0], np.zeros((n, k), int)
    for i in range(1, n):
        step = best[:, None] + move
        back[i] = np.argmax(step, axis=0)
        best = step[back[i], np.arange(k)] + emit[i]
    path = [int(np.argmax(best))]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return np.array(path[::-1]), float(best.max())


def _viterbi2(emit: list[list[float]], move: list[list[float]], begin: list[float]) -> tuple[np.ndarray, float]:
    """``viterbi`` of two states in plain floats: a step costs less than one call of numpy."""
    (m00, m01), (m10, m11) = move
    a, b = begin[0] + emit[0][0], begin[1] + emit[0][1]
    back = []
    for e0, e1 in emit[1:]:
        p, q, r, s = a + m00, b + m10, a + m01, b + m11
        to0, to1 = q > p, s > r
        a, b = (q if to0 else p) + e0, (s if to1 else r) + e1
        back.append((to0, to1))
    path = [int(b > a)]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1]), max(a, b)


def hmm(x: np.ndarray, move: np.ndarray = STAY, rounds: int = 100) -> np.ndarray:
    """Two Gaussian states with the same mean, half and twice the variance, refitted to their passages until stable."""
    mean = np.repeat(x.mean(axis=0)[None], 2, 0)
    var = np.stack([x.var(axis=0) / 2, x.var(axis=0) * 2]) + 1e-7
    begin, before, path = np.log(np.full(2, 0.5)), 1.0, np.zeros(len(x), int)
    for _ in range(rounds):
        emit = -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - mean[None]) ** 2 / var[None]).sum(axis=2)
        path, likely = viterbi(emit, move, begin)
        if abs((likely - before) / before) <= 0.01:
            break
        before = likely if likely else 1.0
        for s in (0, 1):
            if (path == s).any():
                own = x[path == s]
                new = own.mean(axis=0)
                mean[s], var[s] = (mean[s] + new) / 2, (var[s] + ((own - new) ** 2).mean(axis=0)) / 2 + 1e-7
    return path


def score_hmm(x: np.ndarray, k: int = 2, variant: int = 3) -> np.ndarray:
    """From the distance to the own state's centroid over the largest in that state, by variant.

    1: halved and raised by half in the small state, 0.1 elsewhere; 2: one less it; 3: it; 4: the mean of it and of
    nearness to the small state's centroid.
    """
    if not len(x):
        return np.zeros(0)
    path = hmm(x)
    order = _by_size(path)
    small = path == order[-1] if len(order) > 1 else np.zeros(len(x), bool)
    share = np.zeros(len(x))
    for own in (small, ~small):
        if own.any():
            d = _far(x[own], x[own].mean(axis=0))
            share[own] = d / (d.max() + 1e-6)
    if variant == 1:
        return np.where(small, (1 - share) / 2 + 0.5, 0.1)
    if variant == 2:
        return 1 - share
    if variant == 3 or not small.any() or small.all():
        return share
    a, b = _far(x, x[small].mean(axis=0)), _far(x, x[~small].mean(axis=0))
    return (share + np.divide(b, a + b, out=np.zeros(len(x)), where=a + b > 0)) / 2


def score_combined(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """k-means for each feature alone, weighted (a weight is 1e-5 at least, of their sum) and added, 1 at most."""
    w = np.maximum(1e-5, np.asarray(weights, float) / np.sum(weights))
    return np.minimum(1.0, sum(w[f] * score_kmeans(x[:, f : f + 1]) for f in range(x.shape[1])))


METHODS: dict[str, Callable[..., np.ndarray]] = {
    "kmeans": score_kmeans, "kmedians": score_kmedians, "median_kmeans": score_median_kmeans, "agglom": score_agglom, "hmm": score_hmm,
}
