"""Gradient-boosted trees: fitted on a bounded sample, applied as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf is a number; a split is (feature, threshold, at most the threshold, above it).
Tree = float | tuple


@dataclass
class Boosted:
    features: list[str]
    base: float
    trees: list[Tree]

    def margin(self, value) -> Column:
        """The log odds of a row; value(name) gives a feature's column."""

        def build(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, at, low, high = tree
            return F.when(value(self.features[f]) <= F.lit(float(at)), build(low)).otherwise(build(high))

        out = F.lit(float(self.base))
        for t in self.trees:
            out = out + build(t)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += _apply(t, x)
        return out


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, at, low, high = tree
    left = x[:, f] <= at
    out = np.empty(len(x))
    out[left], out[~left] = _apply(low, x[left]), _apply(high, x[~left])
    return out


def fit(features: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, bins: int = 32, least: int = 8) -> Boosted:
    """Boosted trees for labels 0 and 1 under logistic loss, with second-order gains. Thresholds
    lie between values at quantiles of each feature. One class only, or no rows, gives a
    constant. The result depends on the rows as a set: sums are of rounded gradients."""
    x, y = np.asarray(x, dtype=np.float64).reshape(len(y), len(features)), np.asarray(y, dtype=np.float64)
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Boosted(list(features), float(np.log(p / (1 - p))), [])
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        at = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(v) > bins else v[:-1]
        cuts.append(at)
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> Tree:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = round(float(-rate * gs / (hs + penalty)), 9)
        if level == 0 or len(rows) < 2 * least:
            return value
        best = (1e-6, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            k = code[rows, f]
            gl = np.cumsum(np.bincount(k, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(k, h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (gain[i], (f, i))
        if best[1] is None:
            return value
        f, i = best[1]
        left = code[rows, f] <= i
        return (f, float(cuts[f][i]), grow(rows[left], g, h, level - 1), grow(rows[~left], g, h, level - 1))

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), np.round(q - y, 12), np.round(q * (1 - q), 12), depth)
        model.trees.append(tree)
        margin = margin + _apply(tree, x)
    return model


def threshold(margins: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin at and above which held-out rows reach a precision; if none does,
    above all of them."""
    order = np.argsort(-margins, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[margins[order][1:] != margins[order][:-1], True] if len(y) else np.empty(0, bool)
    ok = np.flatnonzero((good >= precision) & last)
    return float(margins[order][ok[-1]]) if len(ok) else float("inf")
