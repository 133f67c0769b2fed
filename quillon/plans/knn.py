"""k nearest neighbours: exact, two-stage approximate, automatic; for one query or a table of queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_SQ8_CANDIDATES, Metric, SearchOptions, auto_reason, check_vector
from ..errors import invalid
from ..functions.distance import distance, inverse_norms, paired, vector_literal, zero_sign
from ..operators import quantize

#: Columns of prepared codes.
CODES = ("codes", "scale", "sqnorm")
#: Queries times coordinates that are sent to every executor, at most (32 MB of doubles); beyond it, queries go in turns.
QUERY_CELLS = 4_000_000
#: Rows that a task keeps for all queries of a turn, at most (24 bytes each); rows and queries whose product is made at once
#: (it stays in a core's cache), and pairs whose distances are.
HELD_CELLS, TILE, PAIRS = 2_000_000, (1024, 128), 1 << 18
#: Tasks that many queries are dealt to, at most: each gives its best rows for every query.
MAX_TASKS = 64
_FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("distance", pa.float64()), ("near", pa.float64())])


@dataclass(frozen=True)
class Report:
    mode: str
    reason: str
    eligible_count: int
    distance_computations: int
    returned: int
    metric: str

    @property
    def complete(self) -> bool:
        return self.returned == self._wanted

    _wanted: int = 0


def ordered(df: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k rows that come first by distance, -0.0 before 0.0, then id, with their rank from 1."""
    keys = (F.col("distance"), zero_sign(F.col("distance")), F.col(id_col))
    top = df.orderBy(*keys).limit(k)  # bounded heaps in the tasks; k rows meet
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def exact(df: DataFrame, query: list[float], k: int, metric: Metric, id_col: str = "id", vector: str = "vector", where: Column | None = None) -> DataFrame:
    """(id, distance, rank), at most k rows; `where` is applied before ranking."""
    check_vector(query, None, metric)
    if k < 0:
        raise invalid("k must not be negative")
    rows = usable(df if where is None else df.where(where), vector, len(query))
    return ordered(rows.select(id_col, distance(F.col(vector), vector_literal(query), metric).alias("distance")), k, id_col)


def usable(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """The rows that can be compared: their vector isn't null, has that many coordinates and none of them null."""
    v = F.col(vector)
    return df.where(v.isNotNull() & (F.size(v) == dimensions) & ~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(True)))


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in ids (one column); absent ids are ignored, repeated ones count once."""
    name = ids.columns[0]
    return df.join(ids.select(F.col(name).alias(id_col)).distinct(), id_col, "left_semi")


def approximate(df: DataFrame, query: list[float], k: int, metric: Metric, candidates: int = 64, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """Candidates by 8-bit codes, then exact distances of those."""
    if not k <= candidates <= MAX_SQ8_CANDIDATES:
        raise invalid("candidates must be k to 65536")
    check_vector(query, None, metric)
    coded = quantize.encode(usable(df.select(id_col, vector), vector, len(query)), vector)
    near = quantize.approximate_distance(F.col("codes"), F.col("scale"), F.col("sqnorm"), quantize.encode_query(query), metric)
    pool = coded.select(id_col, vector, near.alias("near")).orderBy("near", id_col).limit(candidates)
    return ordered(pool.select(id_col, distance(F.col(vector), vector_literal(query), metric).alias("distance")), k, id_col)


def auto(df: DataFrame, query: list[float], k: int, metric: Metric, options: SearchOptions = SearchOptions(), id_col: str = "id", vector: str = "vector", where: Column | None = None) -> tuple[DataFrame, Report]:
    """Chooses as the options say, and reports.  An approximate result that is too short is made exact."""
    options.validate()
    check_vector(query, None, metric)
    rows = df if where is None else df.where(where)
    df, rows = usable(df, vector, len(query)), usable(rows, vector, len(query))
    counts = df.agg(F.count("*").alias("n"), (F.count("*") if where is None else F.count_if(where)).alias("m")).first()
    reason = auto_reason(options, k, counts["m"], counts["n"])
    found = min(k, counts["m"])
    if reason.startswith("Ann") and k:
        pool = max(k, options.ef_search)
        return approximate(rows, query, k, metric, pool, id_col, vector), Report("ann", reason, counts["m"], min(pool, counts["m"]), found, metric.value, found)
    return exact(rows, query, k, metric, id_col, vector), Report("exact", reason, counts["m"], counts["m"] if k else 0, found, metric.value, found)


def _first(near: np.ndarray, ids: np.ndarray, some: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the `some` rows that come first for each query, by distance, then id."""
    limit = np.partition(near, some - 1, axis=0)[some - 1]
    take = near <= limit[None, :]
    for q in np.flatnonzero(take.sum(0) > some):  # ties at the limit: the smallest ids stay
        tied = np.flatnonzero(near[:, q] == limit[q])
        kept = some - int((near[:, q] < limit[q]).sum())
        take[tied[np.argsort(ids[tied], kind="stable")[kept:]], q] = False
    return np.nonzero(take)


class _Sides:
    """Queries as a matrix whose product with that of rows is about distance - limit: a cheap bound that finds what must be looked at.

    By codes, vectors are what the codes stand for.  A row's slack is above all rounding, of the product and of the exact distances.
    """

    def __init__(self, q: np.ndarray, metric: Metric, coded: bool):
        self.metric, self.coded = metric, coded
        if coded:
            asked = [quantize.encode_query(v.tolist()) for v in q]
            self.codes = np.array([c for c, _, _ in asked], np.float64).T.copy()
            self.scale, self.sqnorm = np.array([x for _, x, _ in asked]), np.array([x for _, _, x in asked], np.float64)
        self.q = q.astype(np.float64)
        self.seen = self._seen(self.codes.T * self.scale[:, None] if coded else self.q)
        self.squares = (self.seen * self.seen).sum(1)
        self.turned = np.ascontiguousarray(self.q.T)
        self.inverse = inverse_norms(self.q)

    def _seen(self, x: np.ndarray) -> np.ndarray:
        if self.metric is not Metric.COSINE:
            return x
        with np.errstate(invalid="ignore"):
            return x * inverse_norms(x)[:, None]

    def right(self, rows: _Rows, part: slice | np.ndarray, limit: np.ndarray) -> np.ndarray:
        """rows.left @ this is at most 0 wherever the distance may be at most limit, or isn't a number."""
        with np.errstate(invalid="ignore", over="ignore"):
            base = {Metric.SQUARED_L2: self.squares[part], Metric.COSINE: 1.0}.get(self.metric, 0.0)
            least = base - limit - rows.slack * (self.squares[part] + np.abs(limit))
            return np.concatenate([self.seen[part], np.ones((len(limit), 1)), least[:, None]], 1).T

    def own_limit(self, rows: _Rows, first: slice, part: slice | np.ndarray, some: int) -> np.ndarray:
        """For each query, what is not below the distances of `some` of the first rows."""
        with np.errstate(invalid="ignore", over="ignore"):
            g = self.right(rows, part, np.zeros(len(self.squares[part]))).T @ rows.left[first].T
            g += 4 * rows.slack * rows.squares[first]
            own = np.partition(g, some - 1, axis=1)[:, some - 1]
            return own + 4 * rows.slack * (self.squares[part] + np.abs(own))

    def exact(self, rows: _Rows, n: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of pairs, the same bits as kernel's."""
        return paired(rows.turned, n, self.turned, j, self.metric, rows.inverse, self.inverse)

    def near(self, rows: _Rows, n: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances by codes of pairs, the same bits as quantize.approximate_kernel's."""
        dot = np.zeros(len(n))
        for a, b in zip(rows.codes, self.codes, strict=True):
            dot += a[n] * b[j]  # whole numbers
        return quantize.approximate_pairs(dot, rows.scale[n], rows.sqnorm[n], self.scale[j], self.sqnorm[j], self.metric)


class _Rows:
    """One Arrow batch's rows, as _Sides needs them."""

    def __init__(self, x: np.ndarray, sides: _Sides, codes: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
        x = x.astype(np.float64)
        self.turned, self.inverse = np.ascontiguousarray(x.T), inverse_norms(x)
        if codes is not None:
            of, self.scale, self.sqnorm = codes[0].astype(np.float64), codes[1], codes[2].astype(np.float64)
            self.codes = np.ascontiguousarray(of.T)
            x = of * self.scale[:, None]
        x = sides._seen(x)
        with np.errstate(invalid="ignore", over="ignore"):
            squares = (x * x).sum(1)
            self.squares = np.where(np.isfinite(squares), squares, 0.0)
            self.slack = (x.shape[1] + 8) * 1e-15
            first = (squares if sides.metric is Metric.SQUARED_L2 else 0.0) - self.slack * self.squares
            self.left = np.concatenate([x * (-2.0 if sides.metric is Metric.SQUARED_L2 else -1.0), first[:, None], np.ones((len(x), 1))], 1)


class _Best:
    """The `some` rows that come first for each query, of all rows a task has seen: by distance (-0.0 first), or by codes, then id."""

    def __init__(self, sides: _Sides, some: int):
        self.sides, self.some, n = sides, some, len(sides.q)
        self.near, self.far = np.full((n, some), np.inf), np.full((n, some), np.inf)
        self.ids, self.held = np.zeros((n, some), np.int64), np.zeros(n, np.int64)
        self.limit = np.full(n, np.inf)

    def take(self, ids: np.ndarray, rows: _Rows, asked: np.ndarray | None = None) -> None:
        """Puts rows in; with asked, for these queries (in order) only."""
        every = np.arange(len(self.sides.q)) if asked is None else asked
        for at in range(0, len(every), TILE[1]):
            some = every[at : at + TILE[1]]
            part = slice(some[0], some[-1] + 1) if asked is None else some
            limit = self.limit[part]
            if np.isinf(limit).any() and len(ids) > self.some:  # no more than the rows up to the limit of this batch's first ones
                own = self.sides.own_limit(rows, slice(0, max(TILE[0], 2 * self.some)), part, self.some)
                limit = np.where(np.isinf(limit) & np.isfinite(own), own, limit)
            right, ns, js = self.sides.right(rows, part, limit), [], []
            for top in range(0, len(ids), TILE[0]):
                with np.errstate(invalid="ignore", over="ignore"):
                    hit = ~(rows.left[top : top + TILE[0]] @ right > 0)
                n, j = np.divmod(np.flatnonzero(hit), hit.shape[1])
                ns.append(n + top)
                js.append(j)
            n, j = np.concatenate(ns), np.concatenate(js)
            for a in range(0, len(n), PAIRS):
                self._put(ids, rows, n[a : a + PAIRS], some[j[a : a + PAIRS]])

    def _put(self, ids: np.ndarray, rows: _Rows, n: np.ndarray, j: np.ndarray) -> None:
        near = self.sides.near(rows, n, j) if self.sides.coded else self.sides.exact(rows, n, j)
        keep = ~(near > self.limit[j])
        n, j, near = n[keep], j[keep], near[keep]
        if not len(n):
            return
        far = self.sides.exact(rows, n, j) if self.sides.coded else near
        which, of = np.unique(j, return_inverse=True)
        q, place = np.nonzero(np.arange(self.some)[None] < self.held[which][:, None])
        old = which[q], place
        of, near, far, ids = np.concatenate([q, of]), np.concatenate([self.near[old], near]), np.concatenate([self.far[old], far]), np.concatenate([self.ids[old], ids[n]])
        sign = np.zeros(len(near), bool) if self.sides.coded else ~((near == 0) & np.signbit(near))
        order = np.lexsort((ids, sign, near, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, np.arange(len(which)))[of]
        stay = place < self.some
        order, to = order[stay], (which[of[stay]], place[stay])
        self.near[to], self.far[to], self.ids[to] = near[order], far[order], ids[order]
        self.held[which] = np.minimum(np.bincount(of, minlength=len(which)), self.some)
        full = which[self.held[which] == self.some]
        last = self.near[full, -1]
        self.limit[full] = np.where(np.isnan(last), np.inf, last)

    def batches(self, qids: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 18) // self.some)
        for at in range(0, len(qids), step):
            j, place = np.nonzero(np.arange(self.some)[None] < self.held[at : at + step][:, None])
            j += at
            yield pa.RecordBatch.from_arrays([pa.array(qids[j]), pa.array(self.ids[j, place]), pa.array(self.far[j, place]), pa.array(self.near[j, place])], schema=_FOUND)


def best_of(rows: DataFrame, turns: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray | None]], some: int, metric: Metric, coded: bool = False) -> DataFrame:
    """(qid, id, distance, near): for each query the `some` best of the rows (id, v, and codes or a cell) of each task.

    A turn is (qids, vectors, the cells each may look into, or None for all).  Rows are dealt to as many tasks as run at once, at
    most MAX_TASKS, each of which keeps only its best: what is shuffled grows with the queries, not with the rows.
    """
    session, parts = rows.sparkSession, []
    rows = rows.repartition(max(1, min(MAX_TASKS, session.sparkContext.defaultParallelism)))
    for qids, vectors, cells in turns:
        box = session.sparkContext.broadcast((qids, vectors, cells))

        def run(batches: Iterator[pa.RecordBatch], box=box) -> Iterator[pa.RecordBatch]:
            qids, vectors, cells = box.value
            best = None
            for b in batches:
                if not b.num_rows:
                    continue
                best = best or _Best(_Sides(vectors, metric, coded), some)
                ids = np.asarray(b.column(0))
                x = np.asarray(b.column(1).flatten()).reshape(len(ids), -1)
                codes = (np.asarray(b.column(2).flatten()).reshape(len(ids), -1), np.asarray(b.column(3)), np.asarray(b.column(4))) if coded else None
                if cells is None:
                    best.take(ids, _Rows(x, best.sides, codes))
                    continue
                of = np.asarray(b.column(2))
                for cell in np.unique(of):
                    asked = np.flatnonzero((cells == cell).any(1))
                    if len(asked):
                        here = of == cell
                        best.take(ids[here], _Rows(x[here], best.sides, None), asked)
            if best:
                yield from best.batches(qids)

        parts.append(rows.mapInArrow(run, "qid long, id long, distance double, near double"))
    return reduce(DataFrame.union, parts)


def in_turns(asked: Iterable, some: int) -> Iterator[list]:
    """Rows (qid, vector, ...) in lists whose vectors and best rows stay within QUERY_CELLS and HELD_CELLS."""
    held, cells = [], 0
    for row in asked:
        if held and (cells + len(row["vector"]) > QUERY_CELLS or (len(held) + 1) * some > HELD_CELLS):
            yield held
            held, cells = [], 0
        held.append(row)
        cells += len(row["vector"])
    if held:
        yield held


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k first of each query's rows (qid, id, distance), with their rank."""
    order = Window.partitionBy("qid").orderBy("distance", zero_sign(F.col("distance")), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prepared(codes: DataFrame, vectors: DataFrame, query: list[float], k: int, metric: Metric, candidates: int = 64, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """As approximate, from codes that quantize.prepare wrote: the scan reads codes only, and full vectors of the candidates."""
    if not k <= candidates <= MAX_SQ8_CANDIDATES:
        raise invalid("candidates must be k to 65536")
    check_vector(query, None, metric)
    near = quantize.approximate_distance(F.col("codes"), F.col("scale"), F.col("sqnorm"), quantize.encode_query(query), metric)
    pool = codes.where(F.size("codes") == len(query)).select(id_col, near.alias("near")).orderBy("near", id_col).limit(candidates)
    ids = F.broadcast(pool.select(id_col))  # at most 65,536 ids
    return exact(vectors.join(ids, id_col, "left_semi"), query, k, metric, id_col, vector)


def many(df: DataFrame, queries: DataFrame, k: int, metric: Metric, id_col: str = "id", vector: str = "vector", candidates: int | None = None) -> DataFrame:
    """(qid, id, distance, rank) for each row of queries (qid, vector); with candidates, of so many by 8-bit codes for each query.

    Rows of df without a whole vector of the queries' size are not searched.  Codes are taken from df where it has them.
    Each task keeps its k best for a query, so at most k rows per query and task are shuffled, and no pair is a row before
    that.  Query vectors and what a task keeps are within fixed bounds; queries go in turns if there are more.
    """
    if k < 0:
        raise invalid("k must not be negative")
    if k == 0:
        return df.sparkSession.createDataFrame([], "qid long, id long, distance double, rank int")
    if candidates is not None and not k <= candidates <= MAX_SQ8_CANDIDATES:
        raise invalid("candidates must be k to 65536")
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<float>").alias("vector"))
    some, turns, dimensions = candidates or k, [], set()
    for turn in in_turns(asked.toLocalIterator(), some):
        for row in turn:
            check_vector(row["vector"], None, metric)
            dimensions.add(len(row["vector"]))
        if len(dimensions) > 1:
            raise invalid("queries must have the same number of coordinates")
        turns.append((np.array([r["qid"] for r in turn]), np.array([r["vector"] for r in turn], np.float32), None))
    if not turns:
        return df.sparkSession.createDataFrame([], "qid long, id long, distance double, rank int")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), *[c for c in CODES if candidates is not None and c in df.columns])
    rows = usable(rows, "v", dimensions.pop())
    if candidates is not None:
        rows = (rows if set(CODES) <= set(rows.columns) else quantize.encode(rows, "v")).select("id", "v", *CODES)
    found = best_of(rows, turns, some, metric, candidates is not None)
    if candidates is not None:
        nearest = Window.partitionBy("qid").orderBy("near", "id")
        found = found.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= candidates).drop("place")
    return ranked(found.drop("near"), k)
