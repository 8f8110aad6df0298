"""Gradient-boosted trees and isotonic calibration in numpy, for small dense feature matrices."""

from __future__ import annotations

import numpy as np


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float, edges: list[np.ndarray]) -> list:
    """Nested [feature, threshold, left, right] or a leaf's value; rows with a value <= threshold go left."""
    value = -g.sum() / (h.sum() + ridge)
    if depth == 0 or h.sum() < 2 * least:
        return value
    best, base = None, g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        if not len(edges[f]):
            continue
        b = np.searchsorted(edges[f], x[:, f], "left")
        gl, hl = (np.cumsum(np.bincount(b, w, minlength=len(edges[f]) + 1))[:-1] for w in (g, h))
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - base, -1.0)
        k = int(gain.argmax())
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = gain[k], f, float(edges[f][k])
    if best is None:
        return value
    _, f, t = best
    left = x[:, f] <= t
    return [f, t, _tree(x[left], g[left], h[left], depth - 1, least, ridge, edges), _tree(x[~left], g[~left], h[~left], depth - 1, least, ridge, edges)]


def _values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    f, t, left, right = tree
    return np.where(x[:, f] <= t, _values(left, x), _values(right, x))


def boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: float = 0.6, ridge: float = 1.0, bins: int = 24) -> tuple[float, list]:
    """(bias, trees) fitted to labels 0 and 1 of weights w by logistic loss. Thresholds are quantiles of the values seen."""
    p = ((w * y).sum() + 0.5) / (w.sum() + 1)
    bias = float(np.log(p / (1 - p)))
    edges = []
    for c in x.T:
        u = np.unique(c)
        e = u if len(u) <= bins else np.unique(np.concatenate([np.quantile(u, np.linspace(0, 1, bins), method="lower"), u[np.isin(u, (0, 1, 2))]]))
        edges.append(e[e < u[-1]])
    score, out = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, w * (p - y), w * p * (1 - p), depth, least, ridge, edges)
        score += rate * _values(tree, x)
        out.append(tree)
    return bias, [_scaled(t, rate) for t in out]


def _scaled(tree, rate: float):
    return [tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate)] if isinstance(tree, list) else tree * rate


def raw(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    """The log-odds that a model gives."""
    return model[0] + sum((_values(t, x) for t in model[1]), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (score, probability) of the rising function nearest to the labels, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, n in zip(score[order], y[order].astype(float), w[order]):
        blocks.append([s, v, n])
        if len(blocks) > 1 and blocks[-2][0] == s:  # equal scores are one
            b = blocks.pop()
            blocks[-1][1] = (blocks[-1][1] * blocks[-1][2] + b[1] * b[2]) / (blocks[-1][2] + b[2])
            blocks[-1][2] += b[2]
    pooled: list[list[float]] = []
    for b in blocks:
        pooled.append([b[0], b[0], b[1], b[2]])
        while len(pooled) > 1 and pooled[-2][2] >= pooled[-1][2]:
            c = pooled.pop()
            d = pooled[-1]
            d[1], d[2], d[3] = c[1], (d[2] * d[3] + c[2] * c[3]) / (d[3] + c[3]), d[3] + c[3]
    at = np.array([x for b in pooled for x in (b[0], b[1])])
    return at, np.array([x for b in pooled for x in (b[2], b[2])])


def calibrated(steps: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """Probabilities, linear between the steps."""
    return np.interp(score, *steps)


def fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray, folds: int = 5, **params):
    """(model, steps): the steps are those of scores out of fold, so that they don't flatter the model."""
    fold = np.empty(len(y), np.int64)
    for k in (0, 1):  # as many of each label in every fold
        fold[y == k] = np.arange((y == k).sum()) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        held = fold == k
        if held.any() and not held.all():
            out[held] = raw(boosted(x[~held], y[~held], w[~held], **params), x[held])
    return boosted(x, y, w, **params), isotonic(out, y, w)
