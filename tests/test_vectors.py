import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.config import Metric, SearchOptions, Space, Strategy, auto_reason, check_vector
from quillon.errors import EngineError
from quillon.functions.distance import distance, kernel, vector_literal
from quillon.operators import evaluate, quantize
from quillon.plans import ivf, knn

SCHEMA = "id long, vector array<float>"


@pytest.fixture(scope="module")
def cloud(spark):
    """Points on a coarse grid, so that many distances tie."""
    points = np.random.default_rng(2031).integers(-2, 3, (150, 6)).astype(float)
    points[~points.any(1)] = 1.0
    return spark.createDataFrame([(1000 - 3 * i, p.tolist()) for i, p in enumerate(points)], SCHEMA).repartition(6).cache(), {1000 - 3 * i: p for i, p in enumerate(points)}


def plain(points, query, k, metric):
    """Brute force over exact fractions; cosines in floats."""
    q = [Fraction(float(x)) for x in query]

    def far(p):
        v = [Fraction(float(x)) for x in p]
        inner = sum(a * b for a, b in zip(v, q, strict=True))
        if metric is Metric.SQUARED_L2:
            return float(sum((a - b) ** 2 for a, b in zip(v, q, strict=True)))
        if metric is Metric.INNER_PRODUCT:
            return float(-inner)
        return round(1 - float(inner) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in q)), 9)

    return sorted((far(p), i) for i, p in points.items())[:k]


def found(df):
    return [(round(r["distance"], 9) + 0.0, r["id"]) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("metric", list(Metric))
def test_exact_search_is_brute_force(cloud, metric):
    df, points = cloud
    query = [1.0, -2.0, 0.5, 0.0, 3.0, -1.0]
    for k in (0, 1, 23, 10_000):
        got, want = found(knn.exact(df, query, k, metric)), plain(points, query, k, metric)
        assert [d for d, _ in got] == [d for d, _ in want]
        if metric is not Metric.COSINE:  # whose ties may differ in the last bit
            assert got == want
    even = {i: p for i, p in points.items() if i % 2 == 0}
    assert [d for d, _ in found(knn.exact(df, query, 9, metric, where=F.col("id") % 2 == 0))] == [d for d, _ in plain(even, query, 9, metric)]


def test_ids_that_repeat_or_are_absent(spark, cloud):
    df, points = cloud
    some = spark.createDataFrame([(1000,), (1000,), (994,), (5,)], "id long")
    assert {i for _, i in found(knn.exact(knn.by_ids(df, some), [0.0] * 6, 9, Metric.SQUARED_L2))} == {1000, 994}


@pytest.mark.parametrize("metric", list(Metric))
def test_columns_and_kernel_agree_to_the_bit(spark, metric):
    rng = np.random.default_rng(8)
    rows = (rng.standard_normal((30, 11)) * 10.0 ** rng.integers(-3, 4, (30, 1))).astype(np.float32)
    q = rows[4] * np.float32(0.3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], SCHEMA).orderBy("id")
    by_column = [r[0] for r in df.select(distance(F.col("vector"), vector_literal(q.tolist()), metric)).collect()]
    assert kernel(rows, q[None], metric)[:, 0].tolist() == by_column
    exact = [float(x) for x in ((rows.astype(float) - q) ** 2).sum(1)] if metric is Metric.SQUARED_L2 else None
    assert exact is None or np.allclose(by_column, exact, rtol=1e-12)


def test_the_sign_of_zero_decides_before_the_id(spark):
    df = spark.createDataFrame([(4, [0.0, 7.0]), (5, [-0.0, -7.0]), (6, [2.0, 1.0])], SCHEMA)
    got = [math.copysign(1, r["distance"]) for r in knn.exact(df, [3.0, 0.0], 3, Metric.INNER_PRODUCT).orderBy("rank").collect()]
    assert got == sorted(got)


def test_many_queries_equal_single_ones(spark, cloud):
    df, _ = cloud
    asked = df.where("id % 10 = 0")
    for metric in Metric:
        got = {}
        for r in knn.many(df, asked.select(F.col("id").alias("qid"), "vector"), 8, metric).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["id"], r["distance"]))
        for r in asked.collect():
            assert got[r["id"]] == [(x["id"], x["distance"]) for x in knn.exact(df, r["vector"], 8, metric).orderBy("rank").collect()]
    none = asked.limit(0).select(F.col("id").alias("qid"), "vector")
    assert knn.many(df, none, 8, Metric.SQUARED_L2).count() == 0 and knn.many(df.limit(0), asked.select(F.col("id").alias("qid"), "vector"), 8, Metric.SQUARED_L2).count() == 0


def test_rows_without_a_whole_vector_are_not_searched(spark, cloud):
    df, points = cloud
    odd = spark.createDataFrame([(1, None), (2, [1.0, 2.0]), (3, [None, 0.0, 0.0, 0.0, 0.0, 0.0]), (4, []), (0, None)], SCHEMA)
    both = odd.union(df).coalesce(1)
    query = points[1000].tolist()
    asked = spark.createDataFrame([(9, query)], "qid long, vector array<float>")
    for metric in Metric:
        want = found(knn.exact(df, query, 12, metric))
        assert found(knn.exact(both, query, 12, metric)) == want
        assert found(knn.many(both, asked, 12, metric)) == want
        assert found(knn.approximate(both, query, 12, metric, 65_536)) == want
    with pytest.raises(EngineError):
        knn.many(df, asked.union(spark.createDataFrame([(10, [1.0])], "qid long, vector array<float>")), 3, Metric.SQUARED_L2)


def test_equal_vectors_send_k_rows_for_each_batch(spark):
    ids, near = np.array([9, 3, 7, 1, 5]), np.array([[1.0, 0.0], [1.0, 2.0], [1.0, 0.0], [1.0, 0.0], [0.5, 5.0]])
    rows, queries = knn._first(near, ids, 2)
    assert sorted(zip(queries.tolist(), ids[rows].tolist(), strict=True)) == [(0, 1), (0, 5), (1, 1), (1, 7)]


def test_two_stage_search_from_prepared_codes(spark, cloud, tmp_path):
    df, points = cloud
    codes = quantize.prepare(df.union(spark.createDataFrame([(1, None)], SCHEMA)), str(tmp_path / "codes"), 4)
    assert codes.count() == len(points)
    for metric in Metric:
        query = points[970].tolist()
        assert found(knn.prepared(codes, df, query, 7, metric, 40)) == found(knn.approximate(df, query, 7, metric, 40))
        assert found(knn.prepared(codes, df, query, 7, metric, 4000)) == found(knn.exact(df, query, 7, metric))
    truth = knn.exact(df, points[970].tolist(), 7, Metric.SQUARED_L2).withColumn("qid", F.lit(1))
    got = knn.prepared(codes, df, points[970].tolist(), 7, Metric.SQUARED_L2, 40).withColumn("qid", F.lit(1))
    assert evaluate.recall(got, truth, 7).first()["recall"] >= 0.9
    with pytest.raises(EngineError):
        knn.prepared(codes, df, points[970].tolist(), 7, Metric.SQUARED_L2, 6)


def test_codes_round_halves_away_from_zero(spark):
    rows = quantize.encode(spark.createDataFrame([(1, [-254.0, 9.0, 1.0, -1.0, 3.0]), (2, [0.0])], SCHEMA)).orderBy("id").collect()
    assert rows[0]["codes"] == [-127, 5, 1, -1, 2] and rows[0]["scale"] == 2.0 and rows[0]["sqnorm"] == 127**2 + 25 + 1 + 1 + 4
    assert rows[1]["codes"] == [0] and rows[1]["scale"] == 1.0
    assert quantize.encode_query([-254.0, 9.0, 1.0, -1.0, 3.0]) == ([-127, 5, 1, -1, 2], 2.0, 127**2 + 25 + 1 + 1 + 4)


@pytest.mark.parametrize(
    ("options", "k", "eligible", "active", "reason"),
    [
        (SearchOptions(Strategy.EXACT), 5, 70_000, 70_000, "ExactRequested"), (SearchOptions(Strategy.ANN), 5, 3, 3, "AnnRequested"), (SearchOptions(), 5, 200, 70_000, "SmallEligibleSet"),
        (SearchOptions(ef_search=20), 21, 70_000, 70_000, "LargeK"), (SearchOptions(), 5, 4000, 70_000, "SelectiveFilter"), (SearchOptions(), 5, 4097, 70_000, "AnnSelected"), (SearchOptions(), 5, 4000, 30_000, "AnnSelected"),
    ],
)
def test_strategy(options, k, eligible, active, reason):
    assert auto_reason(options, k, eligible, active) == reason


def test_reports(cloud):
    df, points = cloud
    hits, report = knn.auto(df, [0.5] * 6, 4, Metric.SQUARED_L2, where=F.col("id") > 900)
    assert (report.mode, report.reason, report.eligible_count, report.complete) == ("exact", "SmallEligibleSet", 34, True)
    assert found(hits) == plain({i: p for i, p in points.items() if i > 900}, [0.5] * 6, 4, Metric.SQUARED_L2)
    assert knn.auto(df, [0.5] * 6, 4, Metric.SQUARED_L2, SearchOptions(exact_threshold=9))[1].mode == "ann"


@pytest.mark.parametrize(("vector", "dimensions", "metric"), [([], None, Metric.COSINE), ([1.0, math.nan], None, Metric.COSINE), ([-math.inf], None, Metric.SQUARED_L2), ([0.0, 0.0], None, Metric.COSINE), ([1.0], 2, Metric.SQUARED_L2), ([0.0] * 5000, None, Metric.SQUARED_L2)])
def test_vectors_that_are_refused(vector, dimensions, metric):
    with pytest.raises(EngineError):
        check_vector(vector, dimensions, metric)


def test_spaces_must_agree():
    mine = Space("encoder-1", 12, Metric.INNER_PRODUCT)
    mine.check(Space("encoder-1", 12, Metric.INNER_PRODUCT))
    with pytest.raises(EngineError) as e:
        mine.check(Space("encoder-2", 12, Metric.INNER_PRODUCT))
    assert e.value.kind == "EmbeddingMismatch"


def test_relevance_and_latency(spark):
    ranked = spark.createDataFrame([(5, "p", 2), (5, "q", 1), (6, "q", 4), (7, "p", 1), (8, "r", 1)], "qid long, source string, rank int")
    judged = spark.createDataFrame([(5, "p"), (6, "q"), (7, "z"), (8, None), (9, None)], "qid long, expected string")
    r = evaluate.relevance(ranked, judged).first()
    assert (r["queries"], r["answerable"], r["unanswerable_returned"], r["hit_at_1"]) == (5, 3, 1, 0.0)
    assert abs(r["mrr"] - (1 / 2 + 1 / 4) / 3) < 1e-12 and abs(r["recall_at_3"] - 1 / 3) < 1e-12 and abs(r["source_recall"] - 2 / 3) < 1e-12
    assert abs(r["ndcg"] - (1 / math.log2(3) + 1 / math.log2(5)) / 3) < 1e-12
    times = spark.createDataFrame([(float(x),) for x in range(1, 201)], "ms double")
    assert evaluate.latency(times).first().asDict() == {"p50": 100.0, "p95": 190.0, "p99": 198.0}


def test_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((9, 8)) * 6
    points = (centres[rng.integers(0, 9, 400)] + rng.standard_normal((400, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist(), i % 4) for i, p in enumerate(points)] + [(901, None, 0), (903, [1.0], 0)], f"{SCHEMA}, label int")
    for metric in Metric:
        cells = ivf.build(df, str(tmp_path / metric.value), metric, 9)
        assert cells.rows.count() == 400
        query = points[17].tolist()
        assert found(cells.search(query, 9, 99)) == found(knn.exact(df, query, 9, metric))
        assert found(cells.search(query, 9, 99, F.col("label") == 2)) == found(knn.exact(df, query, 9, metric, where=F.col("label") == 2))
        asked = df.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
        truth = knn.many(df, asked, 10, metric)
        assert evaluate.recall(cells.many(asked, 10, 99), truth, 10).first()["recall"] == 1.0
        if metric is not Metric.INNER_PRODUCT:
            assert evaluate.recall(cells.many(asked, 10, 3), truth, 10).first()["recall"] >= 0.9
    with pytest.raises(EngineError):
        ivf.Cells(spark, str(tmp_path / "none"))
