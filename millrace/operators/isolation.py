"""An isolation forest over one numeric column, as intervals of values.

Each tree splits a sample of SIZE values at random points until they stand alone.
On one column the forest's score is a step function of the value, so the forest
becomes the intervals of values whose score stays at 1/2 or below; Spark then
tests a few comparisons a row, whatever the number of trees.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np

TREES, SIZE = 100, 256
#: Values that the trees are drawn from, at most about; a bounded sample by the hash of the row.
SAMPLE = 30_000
MIN_VALUES = 100


def usual_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth at which a search among n values ends without success."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def tree(values: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(sorted split points, depth of each of the intervals between them)."""
    deepest = ceil(log2(max(len(values), 2)))
    splits, depths = [], []

    def part(v: np.ndarray, depth: int) -> None:  # values in order: the intervals come out in order too
        if depth == deepest or len(v) < 2 or v[0] == v[-1]:
            depths.append(depth + float(usual_depth(len(v))))
            return
        at = rng.uniform(v[0], v[-1])
        k = int(np.searchsorted(v, at, side="right"))
        part(v[:k], depth + 1)
        splits.append(at)
        part(v[k:], depth + 1)

    part(np.sort(values), 0)
    return np.array(splits), np.array(depths)


def inliers(values: np.ndarray, seed: int = 0) -> list[tuple[float, float]]:
    """Closed intervals in which the score is 1/2 at most; none or one open on both sides when the forest tells nothing apart."""
    rng = np.random.default_rng(seed)
    size = min(SIZE, len(values))
    grown = [tree(rng.choice(values, size, replace=False), rng) for _ in range(TREES)]
    points = np.unique(np.concatenate([s for s, _ in grown]))
    middle = np.concatenate([[-np.inf], (points[1:] + points[:-1]) / 2, [np.inf]]) if len(points) else np.zeros(1)
    depth = np.mean([d[np.searchsorted(s, middle)] for s, d in grown], axis=0)
    usual = 2.0 ** (-depth / max(float(usual_depth(size)), 1e-9)) <= 0.5
    edges = np.concatenate([[-np.inf], points, [np.inf]])
    out: list[tuple[float, float]] = []
    for i in np.flatnonzero(usual):
        lo, hi = float(edges[i]), float(edges[i + 1])
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out
