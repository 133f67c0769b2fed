"""Recall of searches and relevance of rankings."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: queries, hits, recall at k, and queries with fewer than k results; both (qid, id, rank)."""
    f, t = found.where(F.col("rank") <= k).select("qid", "id"), truth.where(F.col("rank") <= k).select("qid", "id")
    hits = t.join(f.withColumn("hit", F.lit(1)), ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    return hits.agg(F.count("*").alias("queries"), F.sum("hits").alias("hits"), (F.sum("hits") / F.sum("wanted")).alias("recall"), F.count_if(F.col("wanted") < k).alias("short"))


def relevance(ranked: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """ranked (qid, source, rank), judgments (qid, expected or null) -> one row of hit@1, recall@3, MRR, nDCG, recall@k.

    A query counts with the best rank of its expected source among the first k; those without one only say how often
    something came back.
    """
    best = ranked.where(F.col("rank") <= k).groupBy("qid", F.col("source").alias("expected")).agg(F.min("rank").alias("r"))
    back = ranked.select("qid").distinct().withColumn("back", F.lit(True))
    rows = judgments.join(best, ["qid", "expected"], "left").join(back, "qid", "left")
    can = F.col("expected").isNotNull()
    mean = lambda x: F.avg(F.when(can, F.coalesce(x, F.lit(0.0))))
    return rows.agg(
        F.count("*").alias("queries"), F.count_if(can).alias("answerable"),
        mean(F.when(F.col("r") == 1, 1.0)).alias("hit_at_1"), mean(F.when(F.col("r") <= 3, 1.0)).alias("recall_at_3"),
        mean(1.0 / F.col("r")).alias("mrr"), mean(1.0 / F.log2(F.col("r") + 1.0)).alias("ndcg"), mean(F.when(F.col("r").isNotNull(), 1.0)).alias("source_recall"),
        F.count_if(~can & F.col("back").isNotNull()).alias("unanswerable_returned"),
    )


#: Bits of a value that a pass of `quantiles` settles; four passes settle all 64.
_STEP = 16


def _in_order(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; -0.0 is 0.0, NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _value(order: int) -> float:
    bits = order ^ (1 << 63) if order >> 63 else order ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def quantiles(times: DataFrame, column: str, shares: tuple[Fraction, ...]) -> list[float | None]:
    """The smallest values with at least these shares of all values at or below them; nulls don't count.

    Four passes, each by 16 bits more of the values: a task counts at most 2^16 numbers for each share, and so many meet, whatever
    the number of rows or of different values.
    """
    one = times.select(F.col(column).cast("double").alias("x")).where("x is not null")
    known, left = [0] * len(shares), None
    for at in range(64 - _STEP, -1, -_STEP):
        told = sorted(set(known))

        def count(batches: Iterator[pa.RecordBatch], told=told, at=at) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(told), 1 << _STEP), np.int64)
            for b in batches:
                order = _in_order(np.asarray(b.column(0)))
                step = ((order >> np.uint64(at)) & np.uint64((1 << _STEP) - 1)).astype(np.int64)
                above = order >> np.uint64(at + _STEP) if at + _STEP < 64 else np.zeros(len(order), np.uint64)
                for row, k in zip(sums, told, strict=True):
                    row += np.bincount(step[above == np.uint64(k)], minlength=1 << _STEP)
            k, step = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(sums[k, step])], names=["k", "step", "n"])

        rows = one.mapInArrow(count, "k int, step int, n long").groupBy("k", "step").agg(F.sum("n").alias("n")).toPandas()  # at most 2^16 for each share
        by = np.zeros((len(told), 1 << _STEP), np.int64)
        by[rows["k"], rows["step"]] = rows["n"]
        if left is None:
            n = int(by.sum())
            if not n:
                return [None] * len(shares)
            left = [max(1, -(-n * p.numerator // p.denominator)) for p in shares]
        for i, rank in enumerate(left):
            upto = np.cumsum(by[told.index(known[i])])
            step = int(np.searchsorted(upto, rank))
            left[i] = rank - (int(upto[step - 1]) if step else 0)
            known[i] = known[i] << _STEP | step
    return [_value(x) for x in known]


def latency(times: DataFrame, column: str = "ms") -> DataFrame:
    """Nearest-rank percentiles."""
    found = quantiles(times, column, (Fraction(1, 2), Fraction(19, 20), Fraction(99, 100)))
    return times.sparkSession.createDataFrame([tuple(found)], "p50 double, p95 double, p99 double")
