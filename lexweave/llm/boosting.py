"""Histogram gradient-boosted trees for two classes, and isotonic calibration; features come as matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Trees:
    """Complete binary trees flattened into arrays: node i has children 2i+1 and 2i+2, the last level holds values."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds: every row goes down all trees level by level, as array lookups."""
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), dtype=np.int64)
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.value[tree, node - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosts log loss. Without rows or with one class only, a model that gives the smoothed share of label 1."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    rows, features = x.shape
    share = (y.sum() + 0.5) / (rows + 1)
    base, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    if not rows or y.min() == y.max():
        return Trees(feature, threshold, value, base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(rows, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)  # within the level
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-9)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = node * bins + codes[:, f]
                g, h = (np.bincount(cell, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (slope, curve))
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain = np.where((h >= least / 4) & (all_h - h >= least / 4), gain, 0)[:, : len(e)]
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k], feature[t, first + k], threshold[t, first + k] = top[k], f, e[at[k]]
            split = first + node
            node = 2 * node + (x[np.arange(rows), feature[t, split]] > threshold[t, split])
        g, h = np.bincount(node, slope, inner + 1), np.bincount(node, curve, inner + 1)
        value[t] = rate * g / (h + ridge)
        raw = raw + value[t][node]
    return Trees(feature, threshold, value, base)


@dataclass(frozen=True)
class Isotonic:
    """A rising step function through the pooled blocks, straight between their middles."""

    at: np.ndarray
    level: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.level)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pools neighbours that fall; each end is drawn in by half a row, so no score is certain."""
    blocks: list[list[float]] = []  # label sum, rows, raw sum
    for r, label in zip(*(v[np.argsort(raw, kind="stable")] for v in (raw, y))):
        blocks.append([float(label), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    if not blocks:
        return Isotonic(np.zeros(1), np.full(1, 0.5))
    level = np.array([min(max(b[0] / b[1], 0.5 / (b[1] + 1)), 1 - 0.5 / (b[1] + 1)) for b in blocks])
    return Isotonic(np.array([b[2] / b[1] for b in blocks]), np.maximum.accumulate(level))


# --- labelled rows --------------------------------------------------------------------------------------------------


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(parts)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, text, y`` of at most ``most`` labelled documents, the first in order of a hash of the id; null labels are no labels.

    ``usable`` is a condition on ``id``. The sample's ids are broadcast: their number is bounded by ``most``.
    """
    known = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    chosen = known.where(usable).orderBy(F.xxhash64("id"), "id", "y").limit(most)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return texts.join(F.broadcast(chosen), "id")
