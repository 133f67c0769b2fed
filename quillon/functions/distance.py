"""Distances between float arrays: sums in double precision from left to right, so results are the same bits everywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Metric


def vector_literal(values: list[float]) -> Column:
    """A query vector as array<float>."""
    return F.array(*[F.lit(float(np.float32(v))) for v in values]).cast("array<float>")


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(-0.0), lambda acc, x: acc + x)  # -0.0 is the sum of nothing


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        return (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))

    return _fold(F.zip_with(a, b, square))


def inverse_norm(v: Column) -> Column:
    """1 / |v|, 0 for zero."""
    square = dot(v, v)
    return F.when(square == 0, 0.0).otherwise(F.lit(1.0) / F.sqrt(square))


def distance(v: Column, q: Column, metric: Metric) -> Column:
    if metric is Metric.SQUARED_L2:
        return squared_l2(v, q)
    if metric is Metric.INNER_PRODUCT:
        return -dot(v, q)
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - dot(v, q) * inverse_norm(q) * inverse_norm(v)))


def zero_sign(d: Column) -> Column:
    """Sort key between distance and id: -0.0 comes before 0.0, which Spark's order takes for equal."""
    return F.when((d == 0) & (d.cast("string") == "-0.0"), 0).otherwise(1)


def kernel(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """(rows, queries) distances; coordinate by coordinate, hence the same bits as the column expressions."""
    x, q = x.astype(np.float64), q.astype(np.float64)

    def fold(term) -> np.ndarray:
        acc = None
        for j in range(x.shape[1]):
            acc = term(j) - 0.0 if acc is None else acc + term(j)
        return acc

    if metric is Metric.SQUARED_L2:
        return fold(lambda j: (x[:, j, None] - q[None, :, j]) * (x[:, j, None] - q[None, :, j]))
    product = fold(lambda j: x[:, j, None] * q[None, :, j])
    if metric is Metric.INNER_PRODUCT:
        return -product

    return np.clip(1.0 - product * inverse_norms(q)[None, :] * inverse_norms(x)[:, None], 0.0, 2.0)


def inverse_norms(v: np.ndarray) -> np.ndarray:
    """1 / |row|, 0 for zero; the same bits as inverse_norm."""
    square = np.zeros(len(v))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for j in range(v.shape[1]):
            square = square + v[:, j] * v[:, j]
        return np.where(square == 0, 0.0, 1 / np.sqrt(square))


def paired(x: np.ndarray, n: np.ndarray, q: np.ndarray, j: np.ndarray, metric: Metric, x_inverse: np.ndarray, q_inverse: np.ndarray) -> np.ndarray:
    """Distances of the pairs (row n, query j), of matrices (coordinate, row) of doubles; the same bits as kernel's."""
    acc = None
    with np.errstate(invalid="ignore", over="ignore"):
        for a, b in zip(x, q, strict=True):
            u, v = a[n], b[j]
            term = (u - v) * (u - v) if metric is Metric.SQUARED_L2 else u * v
            acc = term - 0.0 if acc is None else acc + term
        if metric is Metric.SQUARED_L2:
            return acc
        return -acc if metric is Metric.INNER_PRODUCT else np.clip(1.0 - acc * q_inverse[j] * x_inverse[n], 0.0, 2.0)
