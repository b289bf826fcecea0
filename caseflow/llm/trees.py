"""Histogram gradient-boosted trees for a two-class label, in numpy, and their traversal as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """``feature``, ``threshold``, ``left``, ``right`` and ``value`` of every node of every tree, one after the other.

    A leaf points at itself, so a walk of ``depth`` steps ends in a leaf of each tree. ``roots`` holds each tree's first node.
    """

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        margin = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                node = np.where(rows[at, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            margin += self.value[node]
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of at most ``bins`` - 1 bins; equal values share a bin."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    least_rows: int = 20,
    ridge: float = 1.0,
) -> Forest:
    """Boost ``trees`` trees on the logistic loss; split gains come from one gradient histogram per level.

    No rows give a score of one half; one class gives its smoothed share.
    """
    n, width = rows.shape
    share = (labels.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < labels.sum() < n:
        cuts = [_cuts(rows[:, j], bins) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], rows[:, j], side="left") for j in range(width)], axis=1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-margin))
            roots.append(len(nodes))
            margin += _grow(nodes, binned, cuts, labels - p, p * (1 - p), depth, bins, rate, least_rows, ridge)
    table = np.array(nodes if nodes else [[0, np.inf, 0, 0, 0]], dtype=float)
    return Forest(
        base, depth, np.array(roots, dtype=np.int64), table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64),
        table[:, 3].astype(np.int64), table[:, 4],
    )


def _grow(nodes, binned, cuts, gradient, hessian, depth, bins, rate, least_rows, ridge) -> np.ndarray:
    """Append one tree to ``nodes``; the step it takes for each row."""
    n, width = binned.shape
    node_of = np.zeros(n, dtype=np.int64)  # place of each row's node among those of this level
    level = [len(nodes)]
    nodes.append([0, np.inf, level[0], level[0], 0.0])
    step = np.zeros(n)
    live = np.ones(n, dtype=bool)
    for left_levels in range(depth, -1, -1):
        at = np.flatnonzero(live)
        if not len(at):
            break
        g = np.bincount(node_of[at], gradient[at], len(level))
        h = np.bincount(node_of[at], hessian[at], len(level))
        best = _best_splits(binned, node_of, at, gradient, hessian, len(level), bins, least_rows, ridge) if left_levels else [None] * len(level)
        following, moved = [], np.full(len(level), -1)
        for k, node in enumerate(level):
            split = best[k]
            if split is None or split[1] >= len(cuts[split[0]]):
                nodes[node] = [0, np.inf, node, node, rate * g[k] / (h[k] + ridge)]
                continue
            moved[k] = len(following)
            children = [len(nodes), len(nodes) + 1]
            nodes[node] = [split[0], cuts[split[0]][split[1]], *children, 0.0]
            for child in children:
                nodes.append([0, np.inf, child, child, 0.0])
                following.append(child)
        ended = at[moved[node_of[at]] < 0]
        step[ended] = np.array([nodes[node][4] for node in level])[node_of[ended]]
        live[ended] = False
        at = at[moved[node_of[at]] >= 0]
        if len(at):
            feature = np.array([0 if s is None else s[0] for s in best])[node_of[at]]
            cut = np.array([0 if s is None else s[1] for s in best])[node_of[at]]
            node_of[at] = moved[node_of[at]] + (binned[at, feature] > cut)
        level = following
    return step


def _best_splits(binned, node_of, at, gradient, hessian, nodes, bins, least_rows, ridge):
    """(feature, bin) with the largest gain for each node of a level, None where none gains."""
    best, gains = [None] * nodes, np.full(nodes, 1e-9)
    for j in range(binned.shape[1]):
        slot = node_of[at] * bins + binned[at, j]
        g, h, c = (np.bincount(slot, w, nodes * bins).reshape(nodes, bins) for w in (gradient[at], hessian[at], None))
        gl, hl, cl = g.cumsum(1), h.cumsum(1), c.cumsum(1)
        gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        gain[(cl < least_rows) | (ct - cl < least_rows)] = 0
        top = gain.argmax(1)
        for k in np.flatnonzero(gain[np.arange(nodes), top] > gains):
            best[k], gains[k] = (j, int(top[k])), gain[k, top[k]]
    return best
