"""Vector metrics as column expressions, and scorers for blocks of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _checked(a: Column, b: Column, value: Column, on_mismatch: str) -> Column:
    """``value``, or what a difference in dimension gives: an error, 0, or the value over the shorter length."""
    if on_mismatch == "truncate":
        return value
    bad = F.lit(0.0) if on_mismatch == "zero" else F.raise_error(F.lit("vector dimensions differ")).cast("double")
    return F.when(F.size(a) != F.size(b), bad).otherwise(value)


def dot(a: Column, b: Column, on_mismatch: str = "error") -> Column:
    a, b = _doubles(a), _doubles(b)
    return _checked(a, b, _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))), on_mismatch)


def l2_squared(a: Column, b: Column, on_mismatch: str = "error") -> Column:
    a, b = _doubles(a), _doubles(b)
    return _checked(a, b, _sum(F.zip_with(a, b, lambda x, y: F.coalesce((x - y) * (x - y), F.lit(0.0)))), on_mismatch)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column, on_mismatch: str = "error") -> Column:
    """0 where a norm is 0. ``truncate`` takes the products over the shorter length, but both whole norms."""
    value = F.coalesce(F.try_divide(dot(a, b, "truncate"), norm(a) * norm(b)), F.lit(0.0))
    return _checked(a, b, value, on_mismatch)


def score(metric: str, a: Column, b: Column, on_mismatch: str = "error") -> Column:
    """Higher is nearer: the squared distance is negated."""
    if metric == "cosine":
        return cosine(a, b, on_mismatch)
    if metric == "dot":
        return dot(a, b, on_mismatch)
    if metric == "l2":
        return 0.0 - l2_squared(a, b, on_mismatch)
    raise ValueError(f"metric must be one of {METRICS}")


def block_scores(metric: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of all queries (rows) against all vectors (columns), in double precision."""
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    if metric == "l2":
        return -((q[:, None, :] - v[None, :, :]) ** 2).sum(-1) + 0.0 if q.size * len(v) <= 1 << 24 else np.stack([-((v - x) ** 2).sum(1) + 0.0 for x in q])
    products = q @ v.T
    if metric == "dot":
        return products
    if metric != "cosine":
        raise ValueError(f"metric must be one of {METRICS}")
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    return np.divide(products, size, out=np.zeros_like(products), where=size > 0)


def pair_scores(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the rows of ``a`` against the same rows of ``b``, summed in order as ``score`` does: equal vectors have
    equal scores, wherever they stand."""

    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    if metric == "l2":
        return 0.0 - total((a - b) * (a - b))
    if metric == "dot":
        return total(a * b) + 0.0
    if metric != "cosine":
        raise ValueError(f"metric must be one of {METRICS}")
    size = np.sqrt(total(a * a)) * np.sqrt(total(b * b))
    return np.divide(total(a * b), size, out=np.zeros(len(a)), where=~(size == 0)) + 0.0


class Ranker:
    """Scores of queries against blocks of vectors by one matrix product, but for a constant of each query, and within a
    margin: what is left out by ``least`` has a lower exact score."""

    def __init__(self, metric: str, queries: np.ndarray):
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.metric, self.queries = metric, queries
        self.size = np.sqrt((queries * queries).sum(1))
        self.left = {"l2": lambda: np.hstack([2 * queries, -np.ones((len(queries), 1))]), "dot": lambda: queries, "cosine": lambda: _unit(queries, self.size)}[metric]()
        self.error = 8 * (queries.shape[1] + 8) * np.finfo(np.float64).eps

    def right(self, vectors: np.ndarray) -> tuple[np.ndarray, float]:
        """What ``products`` takes of a block, and its largest finite norm."""
        squares = (vectors * vectors).sum(1)
        size = np.sqrt(squares)
        finite = size[np.isfinite(size)]
        block = {"l2": lambda: np.hstack([vectors, squares[:, None]]), "dot": lambda: vectors, "cosine": lambda: _unit(vectors, size)}[self.metric]()
        return block.T, float(finite.max()) if len(finite) else 0.0

    def products(self, at: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.left[at] @ right

    def margin(self, at: np.ndarray, largest: float) -> np.ndarray:
        """More than products and exact scores differ by."""
        s = self.size[at]
        return self.error * {"l2": lambda: (s + largest) ** 2, "dot": lambda: s * largest, "cosine": lambda: np.ones_like(s)}[self.metric]()

    def shifted(self, at: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Exact scores on the products' scale."""
        return scores + self.size[at] ** 2 if self.metric == "l2" else scores


def _unit(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.divide(v, size[:, None], out=np.zeros_like(v), where=~(size == 0)[:, None])
