import numpy as np

from quillon import queries
from quillon.config import Metric
from quillon.plans import knn

SF = "/root/testdata/sf0.001"


def test_searches_ask_every_twentieth_row(spark):
    n = queries._vectors(spark, SF).where("id % 20 = 0").count()
    assert queries.recall_sq8(spark, SF).first()["queries"] == n
    assert queries.mrr_ndcg(spark, SF).first()["queries"] == n


def test_many_queries_by_codes_find_what_one_finds(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((150, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<float>").repartition(3)
    for metric in (Metric.SQUARED_L2, Metric.COSINE):
        got = knn.many(v, v.where("id % 50 = 0").selectExpr("id as qid", "vector"), 5, metric, candidates=7).collect()
        for q in (0, 50, 100):
            want = [(r["rank"], r["id"]) for r in knn.approximate(v, x[q].tolist(), 5, metric, 7).collect()]
            assert sorted((r["rank"], r["id"]) for r in got if r["qid"] == q) == sorted(want)
