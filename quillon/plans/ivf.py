"""Approximate k-NN by cells: every row is written to the cell of its nearest centre, a query reads the cells near it.

Centres are fitted on a bounded sample; all rows are indexed.  Cells are partitions of a table, so that a query's files are known
before the scan, and a filter works as on any table.  Distances within the cells are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import Metric, check_vector
from ..errors import EngineError, invalid
from ..files import Files
from ..functions.distance import distance
from .knn import best_of, exact, in_turns, ranked, usable

#: Rows that the centres are fitted on, at most, chosen by a hash of their id; and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 20_000, 12
#: Centres at most: they are sent to all executors and kept beside the table.
MAX_CELLS = 4096


def _unit(x: np.ndarray, metric: Metric) -> np.ndarray:
    """Vectors as cells see them: by direction for cosine."""
    if metric is not Metric.COSINE:
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def _probed(q: np.ndarray, centres: np.ndarray, metric: Metric, probes: int) -> np.ndarray:
    """The cells that each query looks into, nearest first."""
    far = -(q @ centres.T) if metric is Metric.INNER_PRODUCT else (centres * centres).sum(1)[None] - 2 * q @ centres.T
    return np.argsort(far, 1, kind="stable")[:, :probes].astype(np.int32)


def fit(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centres of a sample: spread-out rows at first, then means of what is nearest to them."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(sample)))]
    far = ((sample - sample[picked[0]]) ** 2).sum(1)
    while len(picked) < min(cells, len(sample)) and far.sum() > 0:
        picked.append(int(rng.choice(len(sample), p=far / far.sum())))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    centres = sample[picked]
    for _ in range(ROUNDS):
        of = _nearest(sample, centres)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build(df: DataFrame, path: str, metric: Metric, cells: int = 64, id_col: str = "id", vector: str = "vector") -> Cells:
    """Writes df (id, vector, other columns) by cells below path.  Rows without a whole vector are left out."""
    if not 1 <= cells <= MAX_CELLS:
        raise invalid(f"cells must be 1 to {MAX_CELLS}")
    spark = df.sparkSession
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if first is None:
        raise invalid("there is no vector")
    rows = usable(df, vector, first[0])
    some = rows.select(vector, F.xxhash64(F.col(id_col).cast("string")).alias("h")).orderBy("h").limit(SAMPLE_ROWS)
    sample = _unit(np.array([r[vector] for r in some.collect()], np.float64), metric)  # at most SAMPLE_ROWS rows
    centres = fit(sample, cells)
    box = spark.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = b.schema.names.index(vector)
                x = np.asarray(b.column(at).flatten(), np.float64).reshape(b.num_rows, -1)
                yield b.append_column("cell", pa.array(_nearest(_unit(x, metric), box.value), pa.int32()))

    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType())])
    placed = rows.mapInArrow(work, schema)
    # a large cell is several files: rows are dealt by cell and a hash of their id
    placed.repartition("cell", F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(8))).write.partitionBy("cell").mode("errorifexists").parquet(f"{path}/cells")
    Files(spark, path).create("cells.json", {"metric": metric.value, "id": id_col, "vector": vector, "centres": centres.tolist()})
    return Cells(spark, path)


class Cells:
    def __init__(self, spark: SparkSession, path: str):
        files = Files(spark, path)
        if not files.exists("cells.json"):
            raise EngineError("NotFound", path)
        said = files.read("cells.json")
        self.metric, self.id, self.vector = Metric(said["metric"]), said["id"], said["vector"]
        self.centres = np.array(said["centres"])
        self.rows = spark.read.parquet(f"{path}/cells")

    def near(self, query: list[float], probes: int) -> list[int]:
        """The cells to read, nearest first; by inner product, those of the centres that have the largest."""
        check_vector(query, self.centres.shape[1], self.metric)
        if probes < 1:
            raise invalid("probes must be at least 1")
        q = _unit(np.array([query], np.float64), self.metric)
        far = -(self.centres @ q[0]) if self.metric is Metric.INNER_PRODUCT else ((self.centres - q) ** 2).sum(1)
        return np.argsort(far, kind="stable")[:probes].tolist()

    def search(self, query: list[float], k: int, probes: int = 8, where: Column | None = None) -> DataFrame:
        """(id, distance, rank): the k nearest rows of the cells nearest to the query; all cells give the exact answer."""
        some = self.rows.where(F.col("cell").isin(self.near(query, probes)))
        return exact(some, query, k, self.metric, self.id, self.vector, where)

    def many(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(qid, id, distance, rank) for each row of queries (qid, vector): each query meets the rows of its cells.

        Queries go to all executors with their cells, within fixed bounds and in turns if there are more; each task keeps its k best.
        Where ids aren't whole numbers of at most 64 bits, queries and rows meet by an equi-join.
        """
        if k < 0:
            raise invalid("k must not be negative")
        kind = dict(self.rows.dtypes)[self.id]
        if kind not in ("tinyint", "smallint", "int", "bigint"):
            return self._many_joined(queries, k, probes)
        none = self.rows.sparkSession.createDataFrame([], f"qid long, id {kind}, distance double, rank int")
        asked = usable(queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<float>").alias("vector")), "vector", self.centres.shape[1])
        turns = []
        for turn in in_turns(asked.toLocalIterator(), k) if k else ():
            x = np.array([r["vector"] for r in turn], np.float32)
            q = _unit(x.astype(np.float64), self.metric)
            turns.append((np.array([r["qid"] for r in turn]), x, _probed(q, self.centres, self.metric, probes)))
        if not turns:
            return none
        rows = self.rows.select(F.col(self.id).cast("long").alias("id"), F.col(self.vector).cast("array<float>").alias("v"), F.col("cell").cast("int").alias("cell"))
        return ranked(best_of(rows, turns, k, self.metric).select("qid", F.col("id").cast(kind).alias("id"), "distance"), k)

    def _many_joined(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        centres, metric = self.centres, self.metric

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    q = _unit(np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1), metric)
                    cells = _probed(q, centres, metric, probes)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.tolist(), pa.list_(pa.int32()))], names=["qid", "q", "cells"])

        asked = usable(queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<float>").alias("q")), "q", centres.shape[1])
        placed = asked.mapInArrow(work, "qid long, q array<float>, cells array<int>").select("qid", "q", F.explode("cells").alias("cell"))
        met = self.rows.join(placed, "cell").select("qid", F.col(self.id).alias("id"), distance(F.col(self.vector), F.col("q"), metric).alias("distance"))
        return ranked(met, k)
