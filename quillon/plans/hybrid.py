"""Rank fusion, neighbouring chunks, grouping, paging and other steps around a search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_CONTEXT_RADIUS, MAX_PAGE, HybridOptions, Metric, check_vector
from ..errors import invalid
from ..functions.distance import distance, vector_literal, zero_sign
from ..operators import keyword
from . import knn


def fuse(vector: DataFrame, words: DataFrame, k: int, options: HybridOptions = HybridOptions()) -> DataFrame:
    """Reciprocal rank fusion of (id, distance, rank) and (id, score, rank): the k best by fused score, then id."""
    options.validate(k)
    v = vector.where(F.col("rank") <= options.candidates).select("id", F.col("rank").alias("vector_rank"), "distance")
    w = words.where(F.col("rank") <= options.candidates).select("id", F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score"))
    share = lambda rank: F.coalesce(F.lit(1.0) / (options.rrf_k + F.col(rank)), F.lit(0.0))
    both = v.join(w, "id", "full_outer").withColumn("score", share("vector_rank") + share("keyword_rank"))
    order = (F.desc("score"), F.asc("id"))
    return both.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def search(docs: DataFrame, query: str, vector: list[float], k: int, metric: Metric, options: HybridOptions = HybridOptions(), where: Column | None = None, id_col: str = "id", text: str = "text", vector_col: str = "vector") -> DataFrame:
    """Hybrid search; the same filter holds in both branches."""
    options.validate(k)
    depth = options.candidates if k else 0
    near = knn.exact(docs, vector, depth, metric, id_col, vector_col, where).withColumnRenamed(id_col, "id")
    return fuse(near, keyword.search(docs, query, depth, id_col, text, where=where), k, options)


def context(chunks: DataFrame, centres: DataFrame, radius: int, where: Column | None = None, source: str = "source", order: tuple[str, ...] = ("start_line", "end_line", "id"), id_col: str = "id") -> DataFrame:
    """(centre, position, and the columns of chunks): eligible chunks within radius of each centre (id) in its source.

    Positions count all chunks of the source, hidden ones too; a centre that is absent or hidden has no context.  Only the
    sources of centres are numbered.
    """
    if not 0 <= radius <= MAX_CONTEXT_RADIUS:
        raise invalid(f"radius must be 0 to {MAX_CONTEXT_RADIUS}")
    ok = F.lit(True) if where is None else where
    wanted = chunks.join(centres.select(F.col(centres.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    some = chunks.join(wanted.select(source).distinct(), source, "left_semi")
    numbered = some.withColumn("__at", F.row_number().over(Window.partitionBy(source).orderBy(*order))).withColumn("__ok", ok)
    middle = numbered.join(wanted.select(id_col), id_col, "left_semi").where("__ok").select(F.col(source).alias("__source"), F.col(id_col).alias("centre"), F.col("__at").alias("__mid"))
    near = numbered.where("__ok").join(middle, (F.col(source) == F.col("__source")) & (F.abs(F.col("__at") - F.col("__mid")) <= radius))
    return near.select("centre", (F.col("__at") - F.col("__mid")).alias("position"), *["`" + c.replace("`", "``") + "`" for c in chunks.columns])


def first_of_source(hits: DataFrame, source: str = "source", rank: str = "rank") -> DataFrame:
    """The best hit of each source, in the order they had."""
    best = F.row_number().over(Window.partitionBy(source).orderBy(rank))
    return hits.withColumn("__n", best).where("__n = 1").drop("__n")


def within(hits: DataFrame, max_distance: float, distance: str = "distance") -> DataFrame:
    """Hits up to a distance; those without one go."""
    if max_distance != max_distance or max_distance in (float("inf"), float("-inf")):
        raise invalid("max_distance must be finite")
    return hits.where(F.col(distance) <= max_distance)


def one_for_each_source(search: Callable[[int], DataFrame], k: int, most: int | None = None, source: str = "source") -> tuple[DataFrame, bool]:
    """The k best sources of a search, and whether they are all that it can find.

    search(n) gives n hits with ranks.  It is asked for more than k, twice as many each time, until enough sources are among
    them or it gives fewer than it was asked for; a caller that can't wait for all may say how many hits to ask for at `most`.
    Where the rows can be read, nearest_of_each_source gives the same at once.
    """
    if k < 1 or (most is not None and k > most):
        raise invalid("1 <= k <= most")
    n = k
    while True:
        n = 2 * n if most is None else min(most, 2 * n)
        hits = search(n)
        best = first_of_source(hits, source)
        sources, found = best.count(), hits.count()
        if sources >= k or found < n or n == most:
            top = best.orderBy("rank").limit(k)
            return top.withColumn("rank", F.row_number().over(Window.orderBy("rank"))), sources >= k or found < n  # k rows meet


def nearest_of_each_source(df: DataFrame, query: list[float], k: int, metric: Metric, source: str = "source", id_col: str = "id", vector: str = "vector", where: Column | None = None) -> DataFrame:
    """(id, source, distance, rank): the nearest row of each source, and of those the k nearest.

    One scan of all rows, however far down the second source is: each task keeps a row for each source.
    """
    check_vector(query, None, metric)
    if k < 0:
        raise invalid("k must not be negative")
    rows = knn.usable(df if where is None else df.where(where), vector, len(query))
    far = rows.select(id_col, source, distance(F.col(vector), vector_literal(query), metric).alias("distance"))
    best = far.groupBy(source).agg(F.min(F.struct("distance", zero_sign(F.col("distance")).alias("sign"), id_col)).alias("best"))
    return knn.ordered(best.select(F.col(f"best.{id_col}").alias(id_col), source, "best.distance"), k, id_col)


def page(df: DataFrame, after: int | None, limit: int, id_col: str = "id") -> tuple[DataFrame, int | None]:
    """Rows with ids beyond `after`, at most `limit` in order, and the id to go on after (None: no more)."""
    if not 1 <= limit <= MAX_PAGE:
        raise invalid(f"limit must be 1 to {MAX_PAGE}")
    rows = df if after is None else df.where(F.col(id_col) > after)
    ids = [r[0] for r in rows.select(id_col).orderBy(id_col).limit(limit + 1).collect()]  # limit + 1 rows
    out = rows.where(F.col(id_col) <= ids[min(limit, len(ids)) - 1]) if ids else rows.limit(0)
    return out.orderBy(id_col).limit(limit), ids[limit - 1] if len(ids) > limit else None


def rerank(hits: DataFrame, order: Callable[[list[dict]], list[int]], k: int, id_col: str = "id", most: int = 100) -> DataFrame:
    """The first `most` hits in the order that a caller's function gives their ids; it must name each of them once."""
    rows = hits.orderBy("rank").limit(most).collect()  # at most `most` rows
    ids = order([r.asDict() for r in rows])
    if sorted(ids) != sorted(r[id_col] for r in rows):
        raise invalid("a reranker must return every candidate once")
    place = {i: n + 1 for n, i in enumerate(ids)}
    ranks = hits.sparkSession.createDataFrame([(i, n) for i, n in place.items()], f"{id_col} long, __rank int")
    return hits.drop("rank").join(F.broadcast(ranks), id_col).withColumnRenamed("__rank", "rank").where(F.col("rank") <= k)
