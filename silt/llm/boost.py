"""A small gradient boosting of regression trees on logistic loss, for models that are evaluated as expressions, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None  # feature <= cut
    high: Node | None = None


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))


def _values(t: Node, x: np.ndarray) -> np.ndarray:
    if t.feature < 0:
        return np.full(len(x), t.value)
    return np.where(x[:, t.feature] <= t.cut, _values(t.low, x), _values(t.high, x))


def _grow(x, g, h, depth, least, shrink, ridge) -> Node:
    leaf = Node(value=float(shrink * g.sum() / (h.sum() + ridge)))
    if not depth or len(g) < 2 * least:
        return leaf
    base, best = g.sum() ** 2 / (h.sum() + ridge), (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], g[order].cumsum(), h[order].cumsum()
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + ridge) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + ridge) - base
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(v[at[k]] + v[at[k] + 1]) / 2)
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    rest = (depth - 1, least, shrink, ridge)
    return Node(feature=best[1], cut=best[2], low=_grow(x[low], g[low], h[low], *rest), high=_grow(x[~low], g[~low], h[~low], *rest))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, shrink: float = 0.3, least: int = 8, ridge: float = 1.0) -> Boosted:
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    margin, out = np.full(len(y), start), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        out.append(_grow(x, y - q, q * (1 - q), depth, least, shrink, ridge))
        margin += _values(out[-1], x)
    return Boosted(start, out)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, share); shares are drawn towards the mean by two imagined rows.  A row of weight n counts as n rows."""
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    at, place = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # sum, rows, sum of x
    for a, b, n in zip(at.tolist(), np.bincount(place, y * weight).tolist(), np.bincount(place, weight).tolist()):
        blocks.append([b, n, a * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    mean = np.average(y, weights=weight)
    share = np.maximum.accumulate([(s + 2 * mean) / (n + 2) for s, n, _ in blocks])
    return np.array([t / n for _, n, t in blocks]), share
