"""Gradient boosting on histograms, for the parts of a panel that one task holds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BINS = 255


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Cuts between the values of each column: halfway where there are few values, else at quantiles."""
    out = []
    for column in x.T:
        v = np.unique(column)
        out.append((v[1:] + v[:-1]) / 2 if len(v) <= BINS else np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])))
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1) if x.shape[1] else np.zeros(x.shape, dtype=int)


def _histogram(codes: np.ndarray, rows: np.ndarray, weights: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """(gradients, hessians, rows) by column and bin of some rows, all columns at once."""
    columns = codes.shape[1]
    flat = (codes[rows] + np.arange(columns) * width).ravel()
    total = lambda w: np.bincount(flat, w, columns * width)
    return np.stack([total(np.repeat(weights[0][rows], columns)), total(np.repeat(weights[1][rows], columns)), total(None)]).reshape(3, columns, width)


def _best_split(histogram: np.ndarray, l2: float, least: int) -> tuple[float, int, int] | None:
    """(gain, column, last bin of the left) of the best cut."""
    g, h, k = histogram.cumsum(axis=2)
    total_g, total_h, n = g[0, -1], h[0, -1], k[0, -1]
    gain = g**2 / (h + l2 + 1e-12) + (total_g - g) ** 2 / (total_h - h + l2 + 1e-12) - total_g**2 / (total_h + l2 + 1e-12)
    gain[(k < least) | (n - k < least)] = -np.inf
    at = int(gain.argmax())
    return (float(gain.flat[at]), *divmod(at, histogram.shape[2])) if gain.flat[at] > 1e-10 else None


def _grow(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, width: int, leaves: int, l2: float, least: int) -> tuple[list, np.ndarray]:
    """(nodes, leaf value of each row): always the leaf that gains most is split."""
    nodes: list = [None]
    rows = {0: np.arange(len(grad))}
    held = {0: _histogram(codes, rows[0], (grad, hess), width)}
    found = {0: _best_split(held[0], l2, least)}
    while len(rows) < leaves and (some := [k for k in found if found[k]]):
        k = max(some, key=lambda i: found[i][0])
        _, column, cut = found.pop(k)
        left = codes[rows[k], column] <= cut
        nodes[k] = (column, cut, len(nodes), len(nodes) + 1)
        parts = (rows[k][left], rows[k][~left])
        # the smaller side is counted, the other is what is left of the parent
        small = int(len(parts[1]) < len(parts[0]))
        counted = _histogram(codes, parts[small], (grad, hess), width)
        both = {small: counted, 1 - small: held.pop(k) - counted}
        for side, part in enumerate(parts):
            rows[len(nodes)], held[len(nodes)] = part, both[side]
            found[len(nodes)] = _best_split(both[side], l2, least) if len(part) >= 2 * least else None
            nodes.append(None)
        del rows[k]
    value = np.zeros(len(grad))
    for k, part in rows.items():
        nodes[k] = -grad[part].sum() / (hess[part].sum() + l2 + 1e-12)
        value[part] = nodes[k]
    return nodes, value


def _followed(nodes: list, codes: np.ndarray) -> np.ndarray:
    at = np.zeros(len(codes), dtype=int)
    value = np.zeros(len(codes))
    for k, node in enumerate(nodes):
        here = at == k
        if isinstance(node, tuple):
            column, cut, left, right = node
            at[here] = np.where(codes[here, column] <= cut, left, right)
        else:
            value[here] = node
    return value


def boosted(x: np.ndarray, y: np.ndarray, classes: bool = False, rate: float = 0.04, rounds: int = 150, leaves: int = 15, l2: float = 0.05, least: int = 20) -> Callable[[np.ndarray], np.ndarray]:
    """Boosted trees of squared error or, for classes of 0 and 1, of log loss; gives means or probabilities."""
    edges = _edges(x)
    codes = _binned(x, edges)
    width = max(map(len, edges), default=0) + 1
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if classes else float(y.mean())
    start = float(np.log(mean / (1 - mean))) if classes else mean
    score, trees = np.full(len(y), start), []
    for _ in range(rounds if x.shape[1] else 0):
        if classes:
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
        else:
            grad, hess = score - y, np.ones(len(y))
        nodes, value = _grow(codes, grad, hess, width, leaves, l2, least)
        trees.append(nodes)
        score = score + rate * value

    def predict(z: np.ndarray) -> np.ndarray:
        own = _binned(z, edges)
        s = start + rate * sum((_followed(t, own) for t in trees), np.zeros(len(z)))
        return 1 / (1 + np.exp(-s)) if classes else s

    return predict
