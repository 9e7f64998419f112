"""Hashed n-gram features and linear models fitted on a bounded sample of labelled rows.

A text becomes four blocks of relative frequencies (words, neighbouring words, characters,
three characters), hashed into one vector. Its score is an offset plus the mean weight of each
block, so scoring needs one gather per position and no per-text index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words

DIMENSIONS = 1 << 18
_MASK = np.uint32(DIMENSIONS - 1)
_BLOCK_SCALE = 10.0
_K = [np.uint32(k) for k in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]


def _scatter(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _K[salt]) * _K[0]
    x = (x ^ (x >> np.uint32(15))) * _K[1]
    return ((x ^ (x >> np.uint32(13))) & _MASK).astype(np.int64)


def hashed_blocks(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block: (text, feature) of every position of all texts; None counts as empty."""
    found = Words(texts)
    words, owner = found.hashes.astype(np.uint32), found.owner()
    text, start = found.windows(2)
    left, right = words[start], words[start + 1]
    # a word that follows itself is one feature whatever the word is
    pairs = np.where(left == right, np.uint32(1), left * _K[2] + right)
    codes = np.frombuffer("".join((t or "") + "\n\n" for t in texts).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    chars = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(int(lengths.sum())) + 2 * chars
    three = (codes[at] * _K[0] + codes[at + 1]) * _K[2] + codes[at + 2] * _K[3]
    return [
        (owner, _scatter(words, 0)),
        (text, _scatter(pairs, 1)),
        (chars, _scatter(codes[at], 2)),
        (chars, _scatter(three, 3)),
    ]


def score_texts(texts, weights: np.ndarray, offset: float) -> np.ndarray:
    total = np.full(len(texts), offset)
    for owner, feature in hashed_blocks(texts):
        sums = np.bincount(owner, weights[feature], minlength=len(texts))
        total += _BLOCK_SCALE * sums / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    return total


def sparse_rows(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, value) arrays of each text, for fitting."""
    n = len(texts)
    keys, values = [], []
    for owner, feature in hashed_blocks(texts):
        key, count = np.unique(owner * DIMENSIONS + feature, return_counts=True)
        size = np.maximum(np.bincount(owner, minlength=n), 1)
        keys.append(key)
        values.append(_BLOCK_SCALE * count / size[key // DIMENSIONS])
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(inverse, np.concatenate(values), minlength=len(key)).astype(np.float32)
    cuts = np.searchsorted(key, np.arange(n + 1) * DIMENSIONS)
    feature = (key % DIMENSIONS).astype(np.int32)
    return [(feature[a:b], value[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Matrix:
    """Rows of a sparse matrix whose columns are those features that occur in it."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    features: np.ndarray
    height: int

    @classmethod
    def of(cls, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Matrix:
        rows = np.repeat(np.arange(len(pairs), dtype=np.int32), [len(f) for f, _ in pairs])
        flat = np.concatenate([f for f, _ in pairs] or [np.empty(0, np.int32)])
        values = np.concatenate([v for _, v in pairs] or [np.empty(0, np.float32)])
        present = np.zeros(int(flat.max(initial=0)) + 1, bool)
        present[flat] = True
        number = np.cumsum(present, dtype=np.int32) - 1
        return cls(rows, number[flat], values, np.flatnonzero(present), len(pairs))

    def take(self, chosen: np.ndarray) -> Matrix:
        """The rows marked in ``chosen``, over the same columns."""
        keep = chosen[self.rows]
        number = np.cumsum(chosen, dtype=np.int32) - 1
        return Matrix(
            number[self.rows[keep]], self.columns[keep], self.values[keep], self.features,
            int(chosen.sum()),
        )

    def between(self, first: int, last: int) -> Matrix:
        """Rows first to last - 1; rows are stored in order."""
        a, b = np.searchsorted(self.rows, [first, last])
        return Matrix(
            self.rows[a:b] - first, self.columns[a:b], self.values[a:b], self.features, last - first
        )

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], minlength=self.height)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * r[self.rows], minlength=len(self.features))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def minimise(start: np.ndarray, value_and_slope, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    x = start
    value, slope = value_and_slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, saved = slope.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * s.dot(q)
            q -= a * y
            saved.append(a)
        if pairs:
            s, y, rho = pairs[-1]
            q /= rho * y.dot(y)
        for (s, y, rho), a in zip(pairs, reversed(saved), strict=True):
            q += (a - rho * y.dot(q)) * s
        fall, size = slope.dot(q), 1.0 if pairs else 1.0 / max(1e-12, np.abs(slope).sum())
        while True:
            tried = x - size * q
            new_value, new_slope = value_and_slope(tried)
            if new_value <= value - 1e-4 * size * fall or size < 1e-10:
                break
            size /= 2
        s, y = tried - x, new_slope - slope
        if s.dot(y) > 1e-12:
            pairs = [*pairs, (s, y, 1.0 / s.dot(y))][-memory:]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = tried, new_value, new_slope
        if done:
            break
    return x


def fit_logistic(matrix: Matrix, labels: np.ndarray, penalty: float, steps: int = 60):
    """(weights by column, offset) of penalised logistic regression; one class alone gives its
    smoothed log odds as the offset."""
    n = max(1, matrix.height)
    y = labels.astype(float)
    odds = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    if matrix.height == 0 or y.min() == y.max():
        return np.zeros(len(matrix.features)), odds

    def value_and_slope(x):
        z = matrix.dot(x[:-1]) + x[-1]
        loss = np.logaddexp(0, z).sum() - (y * z).sum()
        r = sigmoid(z) - y
        slope = np.append(matrix.back(r) / n + penalty * x[:-1], r.sum() / n)
        return loss / n + penalty / 2 * x[:-1].dot(x[:-1]), slope

    x = minimise(np.append(np.zeros(len(matrix.features)), odds), value_and_slope, steps)
    return x[:-1], x[-1]


def fold_of(n: int, folds: int) -> np.ndarray:
    """Rows are dealt to folds in the order in which they come, which callers fix by hash."""
    return np.arange(n) % folds


def calibrate(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * z + offset) a probability of label 1."""
    if len(z) == 0 or labels.min() == labels.max():
        return 1.0, 0.0
    y = labels.astype(float)

    def value_and_slope(x):
        t = x[0] * z + x[1]
        r = (sigmoid(t) - y) / len(z)
        return (np.logaddexp(0, t) - y * t).mean(), np.array([r.dot(z), r.sum()])

    a, b = minimise(np.array([1.0, 0.0]), value_and_slope, 50)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def sample_rows(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, the first by hash of ``key``: the same rows for any partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(bound)
