"""Gradient-boosted trees on binned dense features, and isotonic calibration; numpy, for bounded tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature the thresholds between quantile bins."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


@dataclass
class Trees:
    """Complete trees of one depth: at each node a feature and a threshold, at each leaf a value."""

    depth: int
    start: float
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, damping: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits are found in histograms of gradients."""
    edges = bin_edges(x, bins)
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(depth, float(np.log(prior / (1 - prior))))
    raw = np.full(len(x), trees.start)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = sigmoid(raw)
        gradient, curvature = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(width)
            for j, edge in enumerate(edges):
                n = len(edge) + 1
                if n == 1:
                    continue
                cell = at * n + codes[:, j]
                g = np.bincount(cell, gradient, width * n).reshape(width, n)
                h = np.bincount(cell, curvature, width * n).reshape(width, n)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = gl**2 / (hl + damping) + (gt - gl) ** 2 / (ht - hl + damping) - gt**2 / (ht + damping)
                gain[(hl < damping) | (ht - hl < damping)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i], feature[first + i], threshold[first + i] = top[i], j, edge[k[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, curvature, 2**depth) + damping)
        trees.features.append(feature)
        trees.thresholds.append(threshold)
        trees.leaves.append(value)
        raw += value[leaf]
    return trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing fit of y to raw, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of raw
    for x, label in zip(raw[order], y[order], strict=True):
        blocks.append([label, 1.0, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, count, place = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + count, blocks[-1][2] + place]
    at = np.array([b[2] / b[1] for b in blocks])
    # One pseudo-count of each label keeps calibrated values off 0 and 1.
    return at, np.maximum.accumulate(np.array([(b[0] + 0.5 * y.mean()) / (b[1] + 0.5) for b in blocks]))
