"""Histogram gradient boosting for two classes in numpy, and its trees flattened into arrays.

Features are cut into at most 64 quantile bins, trees grow level by level from per-bin sums of gradients, and a
fitted model is five rectangular arrays `(trees, nodes)`: feature, threshold, left, right, value. Scoring walks all rows
of a batch through one tree at a time, a level per step, with no Python per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    """Flattened trees. A leaf points to itself; `base` is the log-odds before the first tree."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of `x`."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, l, r, v in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                node = np.where(x[rows, f[node]] <= t[node], l[node], r[node])
            total += v[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit(
    x: np.ndarray, y: np.ndarray, *, monotone: dict[int, int] | None = None, trees: int = 80, depth: int = 4,
    rate: float = 0.15, l2: float = 1.0, least: float = 5.0,
) -> Trees:
    """Boosted trees of the logistic loss.

    `monotone` maps a feature to +1 (score never falls as it grows) or -1 (never rises): a split on it whose
    children are ordered the other way is not taken, and each child's values stay on its side of the mean of the
    two, so no deeper split can break the order. No rows or one class only give a constant score: the smoothed
    share of class 1, 0.5 without rows.
    """
    monotone = monotone or {}
    n, width = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** (depth + 1) - 1
    grown: list[tuple] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], 1)
        total = np.full(n, base)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            tree, node = _grow(binned, edges, g, h, monotone, depth, l2, least, rate)
            total += tree[4][node]
            grown.append(tree)
    if not grown:
        grown = [(np.zeros(nodes, np.int32), np.zeros(nodes), np.arange(nodes, dtype=np.int32), np.arange(nodes, dtype=np.int32), np.zeros(nodes))]
    return Trees(base, depth, *(np.stack(parts) for parts in zip(*grown, strict=True)))


def _grow(binned, edges, g, h, monotone, depth, l2, least, rate):
    nodes = 2 ** (depth + 1) - 1
    feature, threshold = np.zeros(nodes, np.int32), np.zeros(nodes)
    left = np.arange(nodes, dtype=np.int32)
    right = left.copy()
    low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
    node = np.zeros(len(g), np.int32)
    open_nodes = [0]
    for level in range(depth):
        first = 2**level - 1
        width = 2**level
        live = node >= first
        at = node[live] - first
        best = {k: (1e-9, None) for k in open_nodes}
        for j in range(binned.shape[1]):
            cuts = len(edges[j])
            if not cuts:
                continue
            key = at * (cuts + 1) + binned[live, j]
            gs = np.bincount(key, g[live], width * (cuts + 1)).reshape(width, cuts + 1).cumsum(1)
            hs = np.bincount(key, h[live], width * (cuts + 1)).reshape(width, cuts + 1).cumsum(1)
            gl, hl = gs[:, :-1], hs[:, :-1]
            gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs[:, -1:]**2 / (hs[:, -1:] + l2)
            gain[(hl < least) | (hr < least)] = -1
            if j in monotone:
                lo, hi = low[first:first + width, None], high[first:first + width, None]
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                gain[monotone[j] * (vr - vl) < 0] = -1
            top = gain.argmax(1)
            for k in open_nodes:
                c = int(top[k - first])
                if gain[k - first, c] > best[k][0]:
                    vl = -gl[k - first, c] / (hl[k - first, c] + l2)
                    vr = -gr[k - first, c] / (hr[k - first, c] + l2)
                    best[k] = (gain[k - first, c], (j, c, vl, vr))
        following = []
        for k, (_, cut) in best.items():
            if cut is None:
                continue
            j, c, vl, vr = cut
            a, b = 2 * k + 1, 2 * k + 2
            feature[k], threshold[k], left[k], right[k] = j, edges[j][c], a, b
            low[a] = low[b] = low[k]
            high[a] = high[b] = high[k]
            if j in monotone:
                middle = (np.clip(vl, low[k], high[k]) + np.clip(vr, low[k], high[k])) / 2
                if monotone[j] > 0:
                    high[a], low[b] = middle, middle
                else:
                    low[a], high[b] = middle, middle
            here = node == k
            node[here] = np.where(binned[here, j] <= c, a, b)
            following += [a, b]
        open_nodes = following
        if not open_nodes:
            break
    gs, hs = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
    value = rate * np.clip(-gs / (hs + l2), low, high)
    return (feature, threshold, left, right, value), node
