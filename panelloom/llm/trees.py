"""Small gradient-boosted trees on numpy for bounded training samples, and their form as Spark SQL expressions."""

from __future__ import annotations

import numpy as np


class Tree:
    """nodes[k] is (feature, threshold, left, right) or a leaf's value; a row goes left if its feature is < threshold."""

    def __init__(self) -> None:
        self.nodes: list = []

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))

        def walk(k: int, rows: np.ndarray) -> None:
            node = self.nodes[k]
            if not isinstance(node, tuple):
                out[rows] = node
                return
            f, t, a, b = node
            left = x[rows, f] < t
            walk(a, rows[left])
            walk(b, rows[~left])

        walk(0, np.arange(len(x)))
        return out

    def sql(self, names: list[str], k: int = 0) -> str:
        node = self.nodes[k]
        if not isinstance(node, tuple):
            return f"{node!r}D"
        f, t, a, b = node
        return f"(CASE WHEN {names[f]} < {t!r}D THEN {self.sql(names, a)} ELSE {self.sql(names, b)} END)"

    def paths(self) -> list[list[tuple[int, str, float]]]:
        """The conditions on the way to every node but the root."""
        out = []

        def walk(k: int, conds: list) -> None:
            if conds:
                out.append(conds)
            if isinstance(self.nodes[k], tuple):
                f, t, a, b = self.nodes[k]
                walk(a, [*conds, (f, "<", t)])
                walk(b, [*conds, (f, ">=", t)])

        walk(0, [])
        return out


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, l2: float, rate: float) -> Tree:
    tree = Tree()

    def make(rows: np.ndarray, left: int) -> int:
        at = len(tree.nodes)
        tree.nodes.append(None)
        gs, hs, best = g[rows].sum(), h[rows].sum(), None
        if left and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                k = len(edges[f]) + 1
                if k < 2:
                    continue
                b = bins[rows, f]
                cg = np.cumsum(np.bincount(b, g[rows], k))[:-1]
                ch = np.cumsum(np.bincount(b, h[rows], k))[:-1]
                cn = np.cumsum(np.bincount(b, minlength=k))[:-1]
                ok = (cn >= least) & (len(rows) - cn >= least)
                gain = np.where(ok, cg**2 / (ch + l2) + (gs - cg) ** 2 / (hs - ch + l2), -np.inf)
                j = int(gain.argmax())
                if gain[j] > gs**2 / (hs + l2) + 1e-9 and (best is None or gain[j] > best[0] + 1e-12):
                    best = (gain[j], f, j)
        if best is None:
            tree.nodes[at] = float(rate * gs / (hs + l2))
        else:
            _, f, j = best
            low = bins[rows, f] <= j
            a = make(rows[low], left - 1)
            b = make(rows[~low], left - 1)
            tree.nodes[at] = (f, float(edges[f][j]), a, b)
        return at

    make(np.arange(len(x)), depth)
    return tree


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 10, l2: float = 1.0, n_bins: int = 32) -> tuple[float, list[Tree]]:
    """(bias, trees) of a logistic model: log odds = bias + sum of trees. Deterministic."""
    edges = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        if len(v) > n_bins:
            v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1), method="nearest"))
        edges.append((v[1:] + v[:-1]) / 2)
    bins = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, trees = float(np.log(p / (1 - p))), []
    z = np.full(len(x), bias)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        t = _grow(x, bins, edges, y - q, q * (1 - q), depth, least, l2, rate)
        trees.append(t)
        z += t.predict(x)
    return bias, trees
