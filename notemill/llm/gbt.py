"""Gradient-boosted trees for binary labels: histogram training and array scoring in numpy, and trees as Spark columns.

train() takes arrays on the driver; train_rows() takes a table of any size, a Spark job a level of each tree. A trained
Forest is a few flat node arrays, small enough to ship with a task; scoring walks all rows of a batch down one level at a
time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators.ranks import at_places
from notemill.shared import checkpoint

#: Rows in one block of binned rows, at most; sums of so many scaled derivatives are exact in a double.
BLOCK = 1 << 16
#: Binned rows that are worth a task of their own.
TASK = 50_000


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: a leaf points to itself and holds a value, an inner node sends x <= threshold to the left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x (rows by features); missing values count as 0."""
        x = np.nan_to_num(np.asarray(x, dtype=np.float64), nan=0.0)
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))

    def margin_column(self, features: list[Column]) -> Column:
        """The same log-odds as one Spark expression over the given columns, for plans without Python."""

        def walk(node: int) -> Column:
            if self.left[node] == node:
                return F.lit(float(self.value[node]))
            test = features[self.feature[node]] <= F.lit(float(self.threshold[node]))
            return F.when(test, walk(self.left[node])).otherwise(walk(self.right[node]))

        total = F.lit(float(self.base))
        for root in self.roots:
            total = total + walk(root)
        return total


def _weight(g: float, h: float, low: float, high: float, ridge: float) -> float:
    return float(np.clip(-g / (h + ridge), low, high))


def _gains(gs: np.ndarray, hs: np.ndarray, g: float, h: float, low: float, high: float, sign: int, least: float, ridge: float):
    """(gain, left weight, right weight) of each cut of one feature, from the sums left of it and those of the node."""
    gain_of = lambda a, b, w: -(a * w + 0.5 * (b + ridge) * w * w)
    wl = np.clip(-gs / (hs + ridge), low, high)
    wr = np.clip(-(g - gs) / (h - hs + ridge), low, high)
    gain = gain_of(gs, hs, wl) + gain_of(g - gs, h - hs, wr) - gain_of(g, h, _weight(g, h, low, high, ridge))
    gain[(hs < least) | (h - hs < least) | (sign * (wr - wl) < 0)] = -np.inf
    return gain, wl, wr


def _bounds(sign: int, low: float, high: float, wl: float, wr: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """Bounds of the values left and right of a split."""
    middle = (wl + wr) / 2
    return {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[sign]


def _base(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def train(
    x: np.ndarray,
    y: np.ndarray,
    n_trees: int = 30,
    depth: int = 3,
    rate: float = 0.3,
    bins: int = 32,
    monotone: list[int] | None = None,
    least: float = 1.0,
    ridge: float = 1.0,
) -> Forest:
    """Fit logistic loss by second-order boosting.

    monotone has, for each feature, 1 or -1 if the score may only rise or fall with it, else 0. A split that breaks this
    is not taken, and the values of its two sides are bounded by the middle between them all the way down, so the whole
    ensemble is monotone. least is the smallest sum of second derivatives in a child. An empty sample, or one with a
    single class, gives a constant forest.
    """
    x = np.nan_to_num(np.asarray(x, dtype=np.float64), nan=0.0)
    y = np.asarray(y, dtype=np.float64)
    x = x if x.ndim == 2 else x.reshape(-1, 1)
    k = x.shape[1]
    signs = monotone or [0] * k
    base = _base(y.mean() if len(y) else 0.5)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if len(y) else np.zeros((0, k), int)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    margin = np.full(len(y), base)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth:
            for j in range(k):
                if not len(edges[j]):
                    continue
                n = len(edges[j]) + 1
                gs = np.cumsum(np.bincount(binned[rows, j], g[rows], n))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, j], h[rows], n))[:-1]
                gain, wl, wr = _gains(gs, hs, total_g, total_h, low, high, signs[j], least, ridge)
                cut = int(np.argmax(gain))
                if gain[cut] > best[0]:
                    best = (gain[cut], (j, cut, wl[cut], wr[cut]))
        if best[1] is None:
            return leaf(_weight(total_g, total_h, low, high, ridge) * rate)
        j, cut, wl, wr = best[1]
        bounds = _bounds(signs[j], low, high, wl, wr)
        goes = binned[rows, j] <= cut
        at = leaf(0.0)
        left = grow(rows[goes], g, h, level + 1, *bounds[0])
        right = grow(rows[~goes], g, h, level + 1, *bounds[1])
        nodes[at] = [j, float(edges[j][cut]), left, right, 0.0]
        return at

    for _ in range(n_trees if 0 < y.sum() < len(y) else 0):
        p = 1.0 / (1.0 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        at = np.full(len(y), roots[-1])
        table = np.array(nodes)
        for _ in range(depth):
            f = table[at, 0].astype(int)
            at = np.where(x[np.arange(len(y)), f] <= table[at, 1], table[at, 2], table[at, 3]).astype(int)
        margin += table[at, 4]
    table = np.array(nodes or [[0, np.inf, 0, 0, 0.0]])
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, dtype=int), depth, base)


def quantiles(values: DataFrame, n: int, groups: int, shares: np.ndarray) -> np.ndarray:
    """numpy's quantiles (groups by shares) of the column `v` in each group 0 to groups - 1 of `j`, of n rows each; exact."""
    virtual = np.asarray(shares) * (n - 1)
    low = np.floor(virtual).astype(np.int64)
    high = np.minimum(low + 1, n - 1)
    places = np.arange(groups, dtype=np.int64)[:, None] * n
    found = at_places(values, ["j", "v"], "v", np.concatenate([places + low, places + high], 1).ravel())
    a, b = (np.array([[found[p] for p in row] for row in (places + at).tolist()]) for at in (low, high))
    t = virtual - low
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


def _walk(nodes: list[list[float]], node: int, cells: np.ndarray, value: list[float]) -> np.ndarray:
    """The value of the leaf that each column of cells (features by rows) reaches from node."""
    feature, cut, left, right = nodes[node][:4]
    if left == node:
        return np.full(cells.shape[1], value[node])
    return np.where(cells[feature] <= cut, _walk(nodes, left, cells, value), _walk(nodes, right, cells, value))


def train_rows(
    rows: DataFrame,
    k: int,
    n_trees: int = 30,
    depth: int = 3,
    rate: float = 0.3,
    bins: int = 32,
    monotone: list[int] | None = None,
    least: float = 1.0,
    ridge: float = 1.0,
) -> Forest:
    """train() on all rows of a table with columns `x` (k finite doubles) and `y` (0 or 1), which is read more than once.

    Edges of bins (256 bins at most) are exact quantiles of all rows. Binned rows are written once, a byte a feature; each level of each tree is
    one job that sums derivatives by node, feature and bin, so the driver holds one such table (at most 2^(depth-1) * k * bins
    rows). Derivatives are summed as whole numbers, so trees do not depend on how rows are dealt.
    """
    n, positives = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = _base(positives / n if n else 0.5)
    if not 0 < positives < n:
        flat = np.zeros(1)
        return Forest(flat.astype(int), flat + np.inf, flat.astype(int), flat.astype(int), flat, np.array([], dtype=int), depth, base)
    signs = monotone or [0] * k
    edges = [np.unique(e) for e in quantiles(rows.select(F.posexplode("x").alias("j", "v")), n, k, np.linspace(0, 1, bins + 1)[1:-1])]
    width = max(map(len, edges)) + 1
    scale = 2.0 ** min(30, 62 - n.bit_length())

    def pack(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                x = np.array(batch["x"].iloc[at : at + BLOCK].tolist()).reshape(-1, k)
                cells = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)
                yield pd.DataFrame({"cells": [cells.tobytes()], "y": [batch["y"].iloc[at : at + BLOCK].to_numpy(np.uint8).tobytes()]})

    blocks = checkpoint(rows.select("x", "y").coalesce(-(-n // TASK)).mapInPandas(pack, "cells binary, y binary"))
    nodes: list[list[float]] = []  # feature, bin, left, right, value
    roots: list[int] = []

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def sums(root: int, wanted: list[int]) -> np.ndarray:
        """Sums of first and second derivatives over all rows, (2, wanted nodes of the tree at root, k, width)."""
        tree, done, shape = [list(x) for x in nodes], list(roots), (2, len(wanted), k, width)
        value = [x[4] for x in tree]
        slot = [-1] * len(tree)
        for s, node in enumerate(wanted):
            slot[node] = s

        def tally(batches):
            total = np.zeros(shape, dtype=np.int64)
            for batch in batches:
                for cells, y in zip(batch["cells"], batch["y"], strict=True):
                    cells, y = np.frombuffer(cells, np.uint8).reshape(k, -1), np.frombuffer(y, np.uint8)
                    margin = np.full(len(y), base)
                    for r in done:
                        margin += _walk(tree, r, cells, value)
                    p = 1.0 / (1.0 + np.exp(-margin))
                    at = _walk(tree, root, cells, slot)
                    held = at >= 0
                    at = at[held] * width
                    both = [np.rint(d[held] * scale) for d in (p - y, p * (1 - p))]
                    for j in range(k):
                        cell = at + cells[j][held]
                        for d in (0, 1):
                            total[d, :, j] += np.bincount(cell, both[d], shape[1] * width).astype(np.int64).reshape(-1, width)
            flat = total.reshape(2, -1)
            met = np.flatnonzero(flat.any(axis=0))
            yield pd.DataFrame({"at": met, "g": flat[0, met], "h": flat[1, met]})

        out = np.zeros((2, shape[1] * k * width))
        for r in blocks.mapInPandas(tally, "at long, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[:, r["at"]] = r["g"] / scale, r["h"] / scale
        return out.reshape(shape)

    for _ in range(n_trees):
        root = leaf(0.0)
        level = [(root, -np.inf, np.inf)]
        for _ in range(depth):
            if not level:
                break
            deeper = []
            for (node, low, high), g, h in zip(level, *sums(root, [x[0] for x in level]), strict=True):
                total_g, total_h = g[0].sum(), h[0].sum()
                nodes[node][4] = _weight(total_g, total_h, low, high, ridge) * rate
                best = (1e-6, None)
                for j in range(k):
                    gs, hs = np.cumsum(g[j])[: len(edges[j])], np.cumsum(h[j])[: len(edges[j])]
                    gain, wl, wr = _gains(gs, hs, total_g, total_h, low, high, signs[j], least, ridge)
                    cut = int(np.argmax(gain))
                    if gain[cut] > best[0]:
                        best = (gain[cut], (j, cut, wl[cut], wr[cut], gs[cut], hs[cut]))
                if best[1] is None:
                    continue
                j, cut, wl, wr, left_g, left_h = best[1]
                bounds = _bounds(signs[j], low, high, wl, wr)
                left = leaf(_weight(left_g, left_h, *bounds[0], ridge) * rate)
                right = leaf(_weight(total_g - left_g, total_h - left_h, *bounds[1], ridge) * rate)
                nodes[node] = [j, cut, left, right, 0.0]
                deeper += [(left, *bounds[0]), (right, *bounds[1])]
            level = deeper
        roots.append(root)
    inner = [x[2] != i for i, x in enumerate(nodes)]
    cuts = [float(edges[x[0]][x[1]]) if i else np.inf for x, i in zip(nodes, inner, strict=True)]
    table = np.array(nodes)
    return Forest(table[:, 0].astype(int), np.array(cuts), table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, dtype=int), depth, base)
