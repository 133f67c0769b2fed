"""8-bit scalar codes of vectors, and distances from them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Metric


def encode(df: DataFrame, vector: str = "vector") -> DataFrame:
    """df plus codes, scale and sqnorm: scale is the largest |x| over 127 (1 for zero), codes round half away from zero."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top == 0, 1.0).otherwise(top / 127.0)
    df = df.withColumn("scale", scale)
    codes = F.transform(vector, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") / F.col("scale")))).cast("tinyint"))
    df = df.withColumn("codes", codes)
    return df.withColumn("sqnorm", F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c.cast("long")))


def encode_query(query: list[float]) -> tuple[list[int], float, int]:
    q = [float(np.float32(x)) for x in query]
    top = max(map(abs, q))
    scale = top / 127.0 if top else 1.0
    codes = [max(-127, min(127, int(math.copysign(math.floor(abs(x / scale) + 0.5), x)))) for x in q]
    return codes, scale, sum(c * c for c in codes)


def approximate_distance(codes: Column, scale: Column, sqnorm: Column, query: tuple[list[int], float, int], metric: Metric) -> Column:
    q, qs, qn = query
    dot = F.aggregate(F.zip_with(codes, F.array(*map(F.lit, q)), lambda a, b: a.cast("long") * b.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    if metric is Metric.SQUARED_L2:
        return F.greatest(F.lit(0.0), scale * scale * sqnorm + qs * qs * qn - F.lit(2.0) * scale * qs * dot)
    if metric is Metric.INNER_PRODUCT:
        return -scale * qs * dot
    norm = F.sqrt(sqnorm.cast("double")) * math.sqrt(qn)
    return F.when(norm == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - dot / norm)))


def approximate_kernel(codes: np.ndarray, scale: np.ndarray, sqnorm: np.ndarray, queries: np.ndarray, metric: Metric) -> np.ndarray:
    """approximate_distance of rows to each query, as (rows, queries)."""
    asked = [encode_query(q.tolist()) for q in queries]
    dot = codes.astype(np.float64) @ np.array([q for q, _, _ in asked], np.float64).T  # whole numbers
    scale, sqnorm = scale[:, None], sqnorm[:, None].astype(np.float64)
    qs, qn = np.array([x for _, x, _ in asked])[None], np.array([x for _, _, x in asked], np.float64)[None]
    if metric is Metric.SQUARED_L2:
        return np.maximum(0.0, scale * scale * sqnorm + qs * qs * qn - 2.0 * scale * qs * dot)
    if metric is Metric.INNER_PRODUCT:
        return -scale * qs * dot
    norm = np.sqrt(sqnorm) * np.sqrt(qn)
    return np.where(norm == 0, 1.0, np.clip(1.0 - dot / np.where(norm == 0, 1.0, norm), 0.0, 2.0))


def approximate_pairs(dot: np.ndarray, scale: np.ndarray, sqnorm: np.ndarray, qs: np.ndarray, qn: np.ndarray, metric: Metric) -> np.ndarray:
    """approximate_distance of pairs, from the products of their codes; the same bits as approximate_kernel's."""
    if metric is Metric.SQUARED_L2:
        return np.maximum(0.0, scale * scale * sqnorm + qs * qs * qn - 2.0 * scale * qs * dot)
    if metric is Metric.INNER_PRODUCT:
        return -scale * qs * dot
    norm = np.sqrt(sqnorm) * np.sqrt(qn)
    return np.where(norm == 0, 1.0, np.clip(1.0 - dot / np.where(norm == 0, 1.0, norm), 0.0, 2.0))


def prepare(df: DataFrame, path: str, sequence: int, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """Writes the codes of a generation's vectors (id, codes, scale, sqnorm) below path, once for each sequence; rows without a vector have none."""
    place = f"{path}/codes-{sequence}"
    rows = df.where(F.col(vector).isNotNull())
    encode(rows.select(id_col, vector), vector).select(id_col, "codes", "scale", "sqnorm").write.mode("overwrite").parquet(place)
    return df.sparkSession.read.parquet(place)
