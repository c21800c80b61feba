"""A random forest in numpy: classification trees on bootstrap samples, Gini splits over random features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # of positives


@dataclass
class Forest:
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of positives over the trees, for each row."""
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t.feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                a = at[inner]
                at[inner] = np.where(x[inner, f[inner]] <= t.threshold[a], t.left[a], t.right[a])
            out += t.share[at]
        return out / max(len(self.trees), 1)


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, leaf: int) -> tuple[float, int, float]:
    n, best = len(y), (np.inf, -1, 0.0)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= leaf) & (n - k >= leaf)
        if not ok.any():
            continue
        a, b = pos[:-1], pos[-1] - pos[:-1]
        gini = a * (k - a) / k + b * (n - k - b) / (n - k)
        gini[~ok] = np.inf
        i = int(gini.argmin())
        if gini[i] < best[0]:
            best = (float(gini[i]), int(f), float((v[i] + v[i + 1]) / 2))
    return best


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 12, leaf: int = 2, seed: int = 0) -> Forest:
    """A forest on rows x with labels y (0, 1)."""
    rng, some, out = np.random.default_rng(seed), max(1, round(x.shape[1] ** 0.5)), []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        feature, threshold, left, right, share = [], [], [], [], []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(feature)
            for part, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (share, float(y[rows].mean()))):
                part.append(v)
            if level == depth or len(rows) < 2 * leaf or share[me] in (0.0, 1.0):
                return me
            _, f, t = _split(x[rows], y[rows], rng.permutation(x.shape[1])[:some], leaf)
            if f >= 0:
                low = x[rows, f] <= t
                feature[me], threshold[me] = f, t
                left[me] = grow(rows[low], level + 1)
                right[me] = grow(rows[~low], level + 1)
            return me

        grow(pick, 0)
        out.append(Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share)))
    return Forest(out)
