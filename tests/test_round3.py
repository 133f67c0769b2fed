import numpy as np
from pyspark.sql import functions as F

from quillon import queries
from quillon.config import Metric
from quillon.functions import text
from quillon.functions.distance import kernel
from quillon.operators import evaluate, keyword
from quillon.plans import hybrid, knn


def _rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("rank").collect()]


def test_a_source_beyond_the_first_512_hits_is_found(spark, tmp_path):
    rows = [(i, [float(i), 0.0], 0 if i < 700 else i - 699) for i in range(702)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.one_source_each(spark, str(tmp_path))
    assert got.columns == ["id", "source", "distance", "rank"]
    assert _rows(got, "id", "source", "distance", "rank") == [(0, 0, 0.0, 1), (700, 1, 490000.0, 2), (701, 2, 491401.0, 3)]


def test_sources_by_search_and_by_scan_are_the_same(spark):
    rng = np.random.default_rng(8)
    points = rng.integers(-2, 3, (300, 2)).astype(float)
    df = spark.createDataFrame([(i, p.tolist(), "near" if (p**2).sum() < 8 else "far" if i % 2 else None) for i, p in enumerate(points)], "id long, vector array<float>, source string").repartition(4)
    for k in (1, 2, 3, 9):
        at_once = hybrid.nearest_of_each_source(df, [0.0, 0.0], k, Metric.SQUARED_L2)
        by_search, complete = hybrid.one_for_each_source(lambda n: queries.knn.exact(df, [0.0, 0.0], n, Metric.SQUARED_L2).join(df.select("id", "source"), "id"), k)
        assert complete and _rows(at_once, "id", "source", "distance", "rank") == _rows(by_search, "id", "source", "distance", "rank")
        assert at_once.count() == min(k, 3)
    only = hybrid.nearest_of_each_source(df, [0.0, 0.0], 3, Metric.SQUARED_L2, where=F.col("source") == "far")
    assert [r["source"] for r in only.collect()] == ["far"]


def _kernel_best(x, ids, q, k, metric):
    d = kernel(x, q, metric)
    return {(j, r + 1): (int(ids[n]), d[n, j]) for j in range(len(q)) for r, n in enumerate(np.lexsort((ids, ~((d[:, j] == 0) & np.signbit(d[:, j])), d[:, j]))[:k])}


def test_what_a_task_keeps_is_what_all_distances_give(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.integers(-2, 3, (400, 6)), rng.standard_normal((300, 6)), rng.standard_normal((40, 6)) * 1e18, np.zeros((9, 6)), np.full((3, 6), 3.0e38)]).astype(np.float32)
    ids = rng.permutation(len(x))
    q = np.concatenate([x[::25], x[-2:]])
    for metric in Metric:
        asked = q[(q != 0).any(1)] if metric is Metric.COSINE else q
        best, qids = knn._Best(knn._Sides(asked, metric, False), 7), np.arange(len(asked))
        for some in np.array_split(np.arange(len(x)), 9):
            best.take(ids[some], knn._Rows(x[some], best.sides, None))
        got = {}
        for b in best.batches(qids):
            for j, i, d in zip(b["qid"].to_pylist(), b["id"].to_pylist(), b["distance"].to_pylist(), strict=True):
                got[(j, sum(a == j for a, _ in got) + 1)] = (i, d)
        want = _kernel_best(x, ids, asked, 7, metric)
        assert got == want


def test_tasks_shuffle_their_best_only(spark, monkeypatch):
    """However many Arrow batches a task reads, it hands on k rows for each query; a turn holds a bounded number of them."""
    x = np.random.default_rng(3).standard_normal((600, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<float>")
    asked = v.where("id % 20 = 0").selectExpr("id as qid", "vector")
    want = sorted(map(tuple, knn.many(v, asked, 3, Metric.COSINE).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    monkeypatch.setattr(knn, "HELD_CELLS", 24)
    made = []
    monkeypatch.setattr(knn, "ranked", lambda found, k, ranked=knn.ranked: made.append(found) or ranked(found, k))
    got = knn.many(v, asked, 3, Metric.COSINE)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got.collect())) == want
    assert made[0].count() == 30 * 3 * spark.sparkContext.defaultParallelism


def test_percentiles_meet_in_bounded_counts(spark):
    """As percentile_disc gives them, and no aggregate holds all different values."""
    rng = np.random.default_rng(6)
    odd = [float("-inf"), float("inf"), float("nan"), -0.0, 0.0, 5e-324, None]
    for values in (rng.standard_normal(997).tolist() + odd, [3.5] * 40, [None, -2.0], (rng.integers(-9, 9, 200) * 1e300).tolist(), odd):
        times = spark.createDataFrame([(x,) for x in values], "ms double").repartition(5)
        want = times.selectExpr(*[f"percentile_disc({p}) within group (order by ms) as p{i}" for i, p in enumerate((0.5, 0.95, 0.99))]).first()
        got = evaluate.latency(times)
        assert str(tuple(got.first())).replace("-0.0", "0.0") == str(tuple(want)).replace("-0.0", "0.0")
        assert "percentile" not in got._jdf.queryExecution().toString()
    assert tuple(evaluate.latency(times.limit(0)).first()) == (None, None, None)


def test_an_index_counts_terms_without_a_shuffle(spark, tmp_path, monkeypatch):
    texts = {1: "b a b", 2: "", 3: None, 4: "zwei x zwei zwei", 5: "백업을 백업"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(2)
    for analyzer in (text.WORDS, text.KOREAN_NGRAM):
        seen = []
        monkeypatch.setattr(keyword.Index, "_write", lambda self, rows, lens, seg, seen=seen, write=keyword.Index._write: seen.append((rows._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, rows.collect())))) or write(self, rows, lens, seg))
        index = keyword.Index.create(spark, str(tmp_path / analyzer), analyzer)
        index.add(docs)
        monkeypatch.undo()
        plan, got = seen[0]
        want = keyword.postings(docs, analyzer=analyzer).join(keyword.lengths(docs), "id").select("term", "id", "tf", "len")
        assert got == sorted(map(tuple, want.collect())) and "Exchange" not in plan
        assert sorted(r["id"] for r in index.documents().collect()) == [1, 2, 3, 4, 5]
