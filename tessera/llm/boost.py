"""Gradient-boosted trees on numpy: small models that are trained where they are used."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, lam: float, least: float) -> tuple[float, int, float]:
    """Best (gain, feature, threshold) over all features, the gain above `least`; thresholds lie halfway between
    neighbouring values."""
    best = (least, -1, 0.0)
    total_g, total_h = g.sum(), h.sum()
    whole = total_g**2 / (total_h + lam)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if at.size:
            gain = cg[at] ** 2 / (ch[at] + lam) + (total_g - cg[at]) ** 2 / (total_h - ch[at] + lam) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, lam: float, least: float) -> tuple:
    leaf = (float(-g.sum() / (h.sum() + lam)),)
    if depth == 0 or len(g) < 2:
        return leaf
    _, j, at = _split(x, g, h, lam, least)
    if j < 0:
        return leaf
    low = x[:, j] <= at
    return j, at, _grow(x[low], g[low], h[low], depth - 1, lam, least), _grow(x[~low], g[~low], h[~low], depth - 1, lam, least)


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    j, at, low, high = tree
    return np.where(x[:, j] <= at, _value(low, x), _value(high, x))


@dataclass
class Boosted:
    """Logistic boosting; margin > 0 means the positive class."""

    rounds: int = 24
    depth: int = 2
    rate: float = 0.5
    lam: float = 0.1
    #: a split must gain more than this
    least: float = 1e-9
    base: float = 0.0
    trees: list[tuple] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        w = np.ones(len(y)) if weight is None else weight
        self.trees, p0 = [], np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = _grow(x, w * (p - y), w * np.maximum(p * (1 - p), 1e-6), self.depth, self.lam, self.least)
            self.trees.append(tree)
            f += self.rate * _value(tree, x)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self.rate * _value(tree, x)
        return f

    def cuts(self) -> dict[int, list[float]]:
        """All thresholds of the trees by feature: between them the decision is constant."""
        found: dict[int, set[float]] = {}
        open_ = list(self.trees)
        while open_:
            tree = open_.pop()
            if len(tree) > 1:
                found.setdefault(tree[0], set()).add(tree[1])
                open_ += tree[2:]
        return {j: sorted(at) for j, at in found.items()}
