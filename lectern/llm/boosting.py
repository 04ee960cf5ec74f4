"""Gradient-boosted trees for a yes/no label, in numpy: histogram splits, monotone constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """All trees in flat arrays; a node with feature -1 is a leaf.  Inputs at or below the threshold go left."""

    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.maximum(self.feature[at], 0)
                at = np.where(inner, np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at]), at)
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _grow(binned, cuts, g, h, monotone, depth, shrink, ridge, least, nodes):
    """Grows one tree depth first; a constrained split keeps its children's values on their sides of the midpoint."""
    n_bins = max(len(c) for c in cuts) + 1

    def leaf(total_g, total_h, low, high):
        return float(np.clip(-total_g / (total_h + ridge), low, high))

    def build(rows, level, low, high):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, shrink * leaf(total_g, total_h, low, high)])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-9, None)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = binned[rows, f]
            left_g = np.cumsum(np.bincount(b, g[rows], n_bins))[: len(cut)]
            left_h = np.cumsum(np.bincount(b, h[rows], n_bins))[: len(cut)]
            left_n = np.cumsum(np.bincount(b, minlength=n_bins))[: len(cut)]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
            allowed = (left_n >= least) & (len(rows) - left_n >= least)
            if monotone[f]:
                rise = np.clip(-right_g / (right_h + ridge), low, high) - np.clip(-left_g / (left_h + ridge), low, high)
                allowed &= rise * monotone[f] >= 0
            gain = np.where(allowed, gain, 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (f, i, left_g[i], left_h[i]))
        if best[1] is None:
            return me
        f, i, lg, lh = best[1]
        low_l, high_l, low_r, high_r = low, high, low, high
        if monotone[f]:
            middle = (leaf(lg, lh, low, high) + leaf(total_g - lg, total_h - lh, low, high)) / 2
            low_l, high_l, low_r, high_r = (low, middle, middle, high) if monotone[f] > 0 else (middle, high, low, middle)
        goes = binned[rows, f] <= i
        left = build(rows[goes], level + 1, low_l, high_l)
        right = build(rows[~goes], level + 1, low_r, high_r)
        nodes[me][:4] = [f, float(cuts[f][i]), left, right]
        return me

    return build(np.arange(len(g)), 0, -np.inf, np.inf)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], n_trees: int = 60, depth: int = 4, shrink: float = 0.15, ridge: float = 1.0, least: int = 20, n_cuts: int = 63) -> Trees:
    """Logistic loss.  Without rows the model says 1/2; with one class only, nearly that class, by a smoothed base rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    out = Trees(base=float(np.log(rate / (1 - rate))))
    if len(y) == 0 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(c, np.arange(1, n_cuts + 1) / (n_cuts + 1), method="lower")) for c in x.T]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    nodes: list[list] = []
    roots = []
    margin = np.full(len(y), out.base)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        start = len(nodes)
        roots.append(_grow(binned, cuts, p - y, p * (1 - p), monotone, depth, shrink, ridge, least, nodes))
        tree = Trees(0.0, *_columns(nodes[start:], start), np.array([0]))
        margin += tree.margin(x)
    return Trees(out.base, *_columns(nodes, 0), np.array(roots))


def _columns(nodes: list[list], shift: int) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, value = zip(*nodes, strict=True)
    return np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64) - shift, np.array(right, np.int64) - shift, np.array(value)
