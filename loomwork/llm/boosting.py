"""Boosted trees on a small table of weighted integer feature rows, and as Column expressions."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Leaf(NamedTuple):
    value: float


class Split(NamedTuple):
    feature: str
    limit: int  # at most: left
    left: Leaf | Split
    right: Leaf | Split


def _grow(x: np.ndarray, names: list[str], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int) -> Leaf | Split:
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None)
    for k in range(x.shape[1]) if depth else ():
        for limit in np.unique(x[rows, k])[:-1]:
            left = x[rows, k] <= limit
            gl, hl = gradient[rows][left].sum(), hessian[rows][left].sum()
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if gain > best[0]:
                best = (gain, (k, int(limit)))
    if best[1] is None:
        return Leaf(float(g / (h + 1)))
    k, limit = best[1]
    left = x[rows, k] <= limit
    return Split(names[k], limit, _grow(x, names, gradient, hessian, rows[left], depth - 1), _grow(x, names, gradient, hessian, rows[~left], depth - 1))


def _apply(tree: Leaf | Split, x: np.ndarray, names: list[str]) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, names.index(tree.feature)] <= tree.limit, _apply(tree.left, x, names), _apply(tree.right, x, names))


def boost(x: np.ndarray, names: list[str], positive: np.ndarray, total: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.4) -> tuple[list[Leaf | Split], np.ndarray]:
    """Trees for the logistic loss by Newton steps, and the margin of each row (the rate is in the leaves)."""
    margin, trees = np.zeros(len(x)), []
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, names, positive - total * p, total * p * (1 - p), np.arange(len(x)), depth)
        trees.append(tree)
        margin = margin + rate * _apply(tree, x, names)
    return trees, margin


def margin_column(trees: list[Leaf | Split], feature: dict[str, Column], rate: float = 0.4) -> Column:
    def column(tree: Leaf | Split) -> Column:
        if isinstance(tree, Leaf):
            return F.lit(rate * tree.value)
        return F.when(feature[tree.feature] <= tree.limit, column(tree.left)).otherwise(column(tree.right))

    out = F.lit(0.0)
    for tree in trees:
        out = out + column(tree)
    return out
