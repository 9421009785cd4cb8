"""Small learners for dense features: boosted trees, isotonic and logistic regression."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Gradient-boosted regression trees on binned features, logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 10, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        # zero-heavy features keep their zero as a bin of its own
        self.edges = [np.unique(np.concatenate([[0.0], np.quantile(c, np.linspace(0, 1, self.bins)[1:-1]), np.quantile(c[c > 0], np.linspace(0, 1, 8)[:-1]) - 1e-12 if (c > 0).any() else []])) for c in x.T]
        codes = self._codes(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        self.nodes = []
        f = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(codes, p - y, p * (1 - p))
            self.nodes.append(tree)
            f += self._tree(codes, tree)
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int16)

    def _grow(self, codes, grad, hess) -> list:
        """Nodes as (feature, bin, left, right) or (None, value, 0, 0)."""
        nodes: list = [None]
        todo = [(0, np.arange(len(grad)), 0)]
        while todo:
            at, rows, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, None, None)
            if level < self.depth and len(rows) >= 2 * self.least:
                for j in range(codes.shape[1]):
                    c, width = codes[rows, j], len(self.edges[j]) + 1
                    gl = np.cumsum(np.bincount(c, grad[rows], width))[:-1]
                    hl = np.cumsum(np.bincount(c, hess[rows], width))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=width))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] is None:
                nodes[at] = (None, float(-self.rate * g / (h + self.ridge)), 0, 0)
                continue
            below = codes[rows, best[1]] <= best[2]
            nodes[at] = (best[1], best[2], len(nodes), len(nodes) + 1)
            nodes += [None, None]
            todo += [(len(nodes) - 2, rows[below], level + 1), (len(nodes) - 1, rows[~below], level + 1)]
        return nodes

    @staticmethod
    def _tree(codes, nodes) -> np.ndarray:
        out, todo = np.zeros(len(codes)), [(0, np.arange(len(codes)))]
        while todo:
            at, rows = todo.pop()
            feature, value, left, right = nodes[at]
            if feature is None:
                out[rows] = value
            else:
                below = codes[rows, feature] <= value
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def decide(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return self.start + sum((self._tree(codes, t) for t in self.nodes), np.zeros(len(x)))


class Isotonic:
    """Non-decreasing step fit of labels on scores (pool adjacent violators)."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> "Isotonic":
        at, first = np.unique(score, return_inverse=True)
        n = np.bincount(first).astype(float)
        mean = np.bincount(first, y) / n
        blocks: list[list[float]] = []
        for v, m, c in zip(at, mean, n):
            blocks.append([m, c, v])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m1, c1, v1 = blocks.pop()
                m0, c0, _ = blocks.pop()
                blocks.append([(m0 * c0 + m1 * c1) / (c0 + c1), c0 + c1, v1])
        self.upto = np.array([b[2] for b in blocks])
        self.value = np.array([b[0] for b in blocks])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        if not len(self.value):
            return 1 / (1 + np.exp(-score))
        return self.value[np.minimum(np.searchsorted(self.upto, score, side="left"), len(self.value) - 1)]


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps; weights per row."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> "Logistic":
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]
        w = np.ones(len(y)) if weight is None else weight
        beta = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            grad = z.T @ (w * (p - y)) + ridge * np.r_[0, beta[1:]]
            hess = (z.T * (w * p * (1 - p) + 1e-9)) @ z + ridge * np.eye(z.shape[1]) + 1e-6 * np.eye(z.shape[1])
            step = np.linalg.solve(hess, grad)
            beta -= step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]
        return z @ self.beta
