"""The engine's queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import HybridOptions, Metric, SearchOptions, Space
from .files import kept_dir
from .functions.distance import distance, vector_literal
from .functions.text import KOREAN_NGRAM, words
from .operators import evaluate, filters, keyword, quantize, store, sync
from .plans import hybrid, ivf, knn
from .sources import ingest

QUERY = "the and of in"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _probe(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return _vectors(spark, sf).where(F.col("id") == vec_id).first()["vector"]


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with tags, numbers and dates; quality is missing where labels has no row."""
    d, lab = _t(spark, sf, "documents"), _t(spark, sf, "labels").select("doc_id", "quality")
    numbers = F.map_filter(F.create_map(F.lit("n_chars"), F.col("n_chars").cast("double"), F.lit("quality"), F.col("quality").cast("double")), lambda _, v: v.isNotNull())
    day = F.date_add(F.to_date(F.lit("2026-01-01")), (F.col("doc_id") % 365).cast("int"))
    dates = F.when(F.col("doc_id") % 5 != 0, F.create_map(F.lit("modified"), day)).otherwise(F.create_map().cast("map<string,date>"))
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "source", F.array("lang", F.lit("all")).alias("tags"), numbers.alias("numbers"), dates.alias("dates"))


def _knn(metric: Metric, k: int = 10):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(knn.exact(_vectors(spark, sf), _probe(spark, sf), k, metric), "distance")

    return query


def _filtered(text: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _docs(spark, sf).where(filters.column(filters.parse(text))).select("id")

    return query


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.exact(_vectors(spark, sf), _probe(spark, sf), 10, Metric.SQUARED_L2, where=F.col("label") == 1), "distance")


def knn_ids(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    ids = v.where("id % 7 = 0").select("id")
    return _rounded(knn.exact(knn.by_ids(v, ids.union(ids)), _probe(spark, sf), 10, Metric.COSINE), "distance")


def knn_metadata(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).withColumn("metadata", F.concat(F.lit("label-"), "label"))
    return _rounded(knn.exact(v, _probe(spark, sf), 5, Metric.INNER_PRODUCT, where=F.col("metadata") == "label-2"), "distance")


def knn_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return _rounded(knn.many(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), 10, Metric.SQUARED_L2), "distance")


def auto_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Searches of each kind, each with its report beside its hits."""
    v, q, out = _vectors(spark, sf), _probe(spark, sf), None
    cases = [(1, 10, None, SearchOptions(exact_threshold=16)), (2, 200, None, SearchOptions(exact_threshold=16)), (3, 10, F.col("id") % 20 == 0, SearchOptions(exact_threshold=4)), (4, 10, F.col("id") % 50 == 0, SearchOptions())]
    for item, k, where, options in cases:
        found, report = knn.auto(v, q, k, Metric.SQUARED_L2, options, where=where)
        named = _rounded(found, "distance").select(F.lit(item).alias("item"), F.lit(report.reason).alias("reason"), F.lit(report.eligible_count).cast("long").alias("eligible"), "id", "distance", "rank")
        out = named if out is None else out.union(named)
    return out


def pairwise_distances(spark: SparkSession, sf: str) -> DataFrame:
    q = vector_literal(_probe(spark, sf, 1))
    return _rounded(_vectors(spark, sf).select("id", *[distance(F.col("vector"), q, m).alias(m.value) for m in Metric]), *[m.value for m in Metric])


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.size(words(F.col("text"))).cast("long").alias("len"))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.term_stats(_t(spark, sf, "documents"), "doc_id")


def bm25(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(keyword.search(_t(spark, sf, "documents"), QUERY, 20, "doc_id"), "score")


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(keyword.search(_t(spark, sf, "documents"), QUERY, 20, "doc_id", where=F.col("lang") == "en"), "score")


def bm25_counters(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.counters(_t(spark, sf, "documents"), QUERY, "doc_id", where=F.col("lang") == "en")


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang").join(_vectors(spark, sf).select("id", "vector"), "id")
    found = hybrid.search(docs, QUERY, _probe(spark, sf), 10, Metric.COSINE, HybridOptions(), where=F.col("lang") == "en")
    return _rounded(_rounded(found, "distance", "keyword_score"), "score", digits=12)


def context_chunks(spark: SparkSession, sf: str) -> DataFrame:
    turns = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("source"), "turn", "role")
    centres = turns.where("id % 5 = 0").select("id")
    return hybrid.context(turns, centres, 2, F.col("role") == "user", order=("turn", "id")).select("centre", "position", "id")


def group_by_source(spark: SparkSession, sf: str) -> DataFrame:
    hits = keyword.search(_t(spark, sf, "documents"), QUERY, 100, "doc_id")
    named = hits.join(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return hybrid.first_of_source(named).select("id", "source", "rank")


def max_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(hybrid.within(knn.exact(_vectors(spark, sf), _probe(spark, sf), 50, Metric.COSINE), 0.7), "distance")


def list_page(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.page(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), 1000, 64, "o_orderkey")[0]


def sq8_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(quantize.encode(_vectors(spark, sf)).select("id", "sqnorm", "scale"), "scale", digits=12)


def sq8_search(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.approximate(_vectors(spark, sf), _probe(spark, sf), 10, Metric.SQUARED_L2, 64), "distance")


def sq8_all_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.approximate(_vectors(spark, sf), _probe(spark, sf), 10, Metric.COSINE, 65_536), "distance")


def _mutations(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.select(F.floor(F.col("event_id") / 100).alias("seq"), (F.col("event_id") % 100).cast("int").alias("ordinal"), F.when(F.col("event_id") % 3 == 0, "delete").otherwise("put").alias("op"), F.col("user_id").alias("id"), "value")


def mutation_fold(spark: SparkSession, sf: str) -> DataFrame:
    return store.fold(_mutations(spark, sf))


def batch_report(spark: SparkSession, sf: str) -> DataFrame:
    return store.batch_report(_mutations(spark, sf), spark.range(0, 50))


def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return store.stats(_vectors(spark, sf))


def doctor(spark: SparkSession, sf: str) -> DataFrame:
    """A table with planted faults: repeated and missing ids, values not finite, short, null and zero vectors."""
    v = _vectors(spark, sf).select("id", "vector")
    nan, zero, short = (f"transform(vector, x -> float('{x}'))" for x in ("NaN", "0", "1"))
    odd = [v.where("id % 7 = 0"), v.where("id % 11 = 0").selectExpr("id + 1000000", f"{nan}"), v.where("id % 13 = 0").selectExpr("id + 2000000", f"{zero}"), v.where("id % 17 = 0").selectExpr("id + 3000000", f"slice({short}, 1, 3)"), v.where("id % 19 = 0").selectExpr("id + 4000000", "cast(null as array<float>)"), v.where("id % 23 = 0").selectExpr("cast(null as long)", "vector")]
    for x in odd:
        v = v.union(x)
    return store.doctor(v, Space("m", 64, Metric.COSINE))


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf: str) -> keyword.Index:
    """The table's index, written once for a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        path = f"{kept_dir(spark)}/quillon-kept/bm25-{uuid.uuid4().hex}"
        keyword.Index.create(spark, path).add(_t(spark, sf, "documents"), id_col="doc_id")
        _INDEXES[key] = path
    return keyword.Index(spark, _INDEXES[key])


def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_index(spark, sf).search(QUERY, 20), "score")


def bm25_indexed_filtered(spark: SparkSession, sf: str) -> DataFrame:
    eligible = _t(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return _rounded(_index(spark, sf).search(QUERY, 20, eligible), "score")


def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Terms, documents and lengths after a change and a merge, as if the index had been built at once."""
    d = _t(spark, sf, "documents").select("doc_id", "text")
    path = f"{kept_dir(spark)}/quillon-kept/bm25-{uuid.uuid4().hex}"
    keyword.Index.create(spark, path).add(d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" stale words"))).otherwise(F.col("text"))), id_col="doc_id")
    keyword.Index(spark, path).add(d.where("doc_id % 3 = 0"), d.where("doc_id % 5 = 0 and doc_id % 3 <> 0").select("doc_id"), id_col="doc_id")
    index = keyword.Index(spark, path)
    index.merge()
    return index._read("postings", "term string, id long, tf long, len long").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.sum("len").alias("lens"))


_CODES: dict[tuple[str, str], str] = {}


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors' codes, written once for a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CODES:
        _CODES[key] = f"{kept_dir(spark)}/quillon-kept/codes-{uuid.uuid4().hex}"
        quantize.prepare(_vectors(spark, sf), _CODES[key], 1)
    return spark.read.parquet(f"{_CODES[key]}/codes-1")


def sq8_prepared(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.prepared(_codes(spark, sf), _vectors(spark, sf), _probe(spark, sf), 10, Metric.SQUARED_L2, 64), "distance")


def sq8_many(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    asked = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    return _rounded(knn.many(v.join(_codes(spark, sf), "id"), asked, 10, Metric.SQUARED_L2, candidates=64), "distance")


_CELLS: dict[tuple[str, str], str] = {}


def _cells(spark: SparkSession, sf: str) -> ivf.Cells:
    """The vectors by cells, written once for a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CELLS:
        path = f"{kept_dir(spark)}/quillon-kept/cells-{uuid.uuid4().hex}"
        ivf.build(_vectors(spark, sf), path, Metric.COSINE, 32)
        _CELLS[key] = path
    return ivf.Cells(spark, _CELLS[key])


def ivf_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """With every cell read, the index gives the exact answer."""
    return _rounded(_cells(spark, sf).search(_probe(spark, sf), 10, 32, F.col("label") == 1), "distance")


def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Of every 20th row as a query: share of the exact ten that the cells near it have."""
    v = _vectors(spark, sf)
    asked = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    return _rounded(evaluate.recall(_cells(spark, sf).many(asked, 10, 20), knn.many(v, asked, 10, Metric.COSINE), 10), "recall")


def knn_null_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a vector, with a short one or with a null coordinate are not searched."""
    v = _vectors(spark, sf)
    bad = F.when(F.col("id") % 3 == 1, F.lit(None)).when(F.col("id") % 9 == 2, F.slice("vector", 1, 5)).when(F.col("id") % 9 == 5, F.transform("vector", lambda x, i: F.when(i != 7, x))).otherwise(F.col("vector"))
    asked = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    return _rounded(knn.many(v.withColumn("vector", bad), asked, 5, Metric.COSINE), "distance")


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.latency(_t(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("ms")))


def rerank_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = knn.exact(_vectors(spark, sf), _probe(spark, sf), 30, Metric.SQUARED_L2)
    return hybrid.rerank(hits, lambda rows: sorted((r["id"] for r in rows), key=lambda i: (i % 7, i)), 10).select("id", "rank")


def korean_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the n-gram analyzer over short Hangul texts made of ids."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.translate((F.col("doc_id") % 1000).cast("string"), "0123456789", "가나다라마바사아자차"), F.lit(" 백업")).alias("text"))
    return keyword.term_stats(d, analyzer=KOREAN_NGRAM)


def bm25_no_match(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.search(_t(spark, sf, "documents").where("doc_id < 0"), QUERY, 5, "doc_id")


def one_source_each(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).withColumnRenamed("label", "source")
    return _rounded(hybrid.nearest_of_each_source(v, _probe(spark, sf), 3, Metric.SQUARED_L2), "distance")


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.extract_html(_t(spark, sf, "pages")).select("page_id", "text")


def chunk_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.chunks(_t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))


def sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("c"), "conv_id", F.lit(".md")).alias("source"), "text", "turn")
    rows = d.select("id", "source", "text", F.col("turn").cast("int").alias("start_line"), F.col("turn").cast("int").alias("end_line"), F.array(F.lit("t")).alias("tags"), F.col("turn").alias("chunk"))
    changed = rows.where("id % 7 <> 0 and id % 1000 <> 3").withColumn("text", F.when(F.col("id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return sync.report(sync.plan(rows, changed, prune=True))


def recall_sq8(spark: SparkSession, sf: str) -> DataFrame:
    """Of every 20th corpus row as a query: share of the exact ten that 64 candidates by codes find."""
    v = _vectors(spark, sf)
    asked = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    truth = knn.many(v, asked, 10, Metric.SQUARED_L2)
    return _rounded(evaluate.recall(knn.many(v, asked, 10, Metric.SQUARED_L2, candidates=64), truth, 10), "recall")


def mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    found = knn.many(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), 10, Metric.COSINE).where("qid <> id")
    named = found.join(v.select("id", F.col("label").alias("source")), "id").select("qid", "source", "rank")
    judged = v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.when(F.col("id") % 10 != 0, F.col("label")).alias("expected"))
    return _rounded(evaluate.relevance(named, judged), "hit_at_1", "recall_at_3", "mrr", "ndcg", "source_recall")


FILTERS = {
    "filter_one_point": ('number("quality") >= 1 AND number("quality") <= 1', "quality = 1"),
    "filter_mixed": ('(tag("en") OR source("src2")) AND NOT (number("n_chars") > 900 AND date("modified") < "2026-07-01")', "(lang = 'en' OR coalesce(source = 'src2', FALSE)) AND NOT (coalesce(n_chars > 900, FALSE) AND doc_id % 5 <> 0 AND DATE '2026-01-01' + CAST(doc_id % 365 AS INT) < DATE '2026-07-01')"),
    "filter_tag_and": ('tag("all") AND tag("en") AND source("src1")', "lang = 'en' AND source = 'src1'"),
    "filter_or": ('tag("de") OR tag("fr")', "lang IN ('de', 'fr')"),
    "filter_not_missing": ('NOT number("quality") = 1', "coalesce(quality <> 1, TRUE)"),
    "filter_ne_missing": ('number("quality") != 0', "coalesce(quality <> 0, TRUE)"),
    "filter_number_range": ('number("n_chars") >= 500 AND number("n_chars") < 2000', "n_chars >= 500 AND n_chars < 2000"),
    "filter_date_range": ('date("modified") >= "2026-03-01" AND NOT date("modified") > "2026-06-30"', "doc_id % 5 <> 0 AND DATE '2026-01-01' + CAST(doc_id % 365 AS INT) BETWEEN DATE '2026-03-01' AND DATE '2026-06-30'"),
}

QUERIES = {
    "knn_l2": _knn(Metric.SQUARED_L2), "knn_cosine": _knn(Metric.COSINE), "knn_ip": _knn(Metric.INNER_PRODUCT),
    "knn_k_zero": _knn(Metric.COSINE, 0), "knn_k_over": _knn(Metric.SQUARED_L2, 100_000),
    **{f.__name__: f for f in (
        knn_filtered, knn_ids, knn_metadata, knn_multi_query, auto_reasons, pairwise_distances, tokens, term_stats, bm25, bm25_filtered, bm25_counters, hybrid_rrf,
        context_chunks, group_by_source, max_distance, list_page, sq8_encode, sq8_search, sq8_all_candidates, mutation_fold, batch_report, store_stats, doctor,
        html_text, chunk_bytes, sync_plan, recall_sq8, mrr_ndcg,
        bm25_indexed, bm25_indexed_filtered, index_postings, sq8_prepared, sq8_many, ivf_all_cells, ivf_recall, knn_null_vectors, latency_percentiles, rerank_hits, korean_terms, bm25_no_match, one_source_each,
    )},
    **{name: _filtered(text) for name, (text, _) in FILTERS.items()},
}

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_DIST = {
    "l2": "list_sum(list_transform(list_zip(e.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "cos": "greatest(0.0, least(2.0, 1.0 - list_inner_product(e.v, q.v) * (1.0 / sqrt(list_inner_product(q.v, q.v))) * (1.0 / sqrt(list_inner_product(e.v, e.v)))))",
    "ip": "-list_inner_product(e.v, q.v)",
}


def _knn_sql(kind: str, k: int = 10, where: str = "TRUE") -> str:
    return f"""WITH {_E}, q AS (SELECT v FROM e WHERE id = 0), d AS (SELECT e.id, {_DIST[kind]} AS d FROM e, q WHERE {where}),
r AS (SELECT id, d, CAST(row_number() OVER (ORDER BY d, id) AS INT) AS rank FROM d)
SELECT id, round(d, 9) AS distance, rank FROM r WHERE rank <= {k}"""


_TERMS = "list_transform(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_-]+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')), lambda w: lower(w))"
_BM25 = f"""w AS (SELECT doc_id AS id, lang, source, {_TERMS} AS ts FROM documents),
n AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS average FROM w),
p AS (SELECT id, lang, len(ts) AS l, t.term, len(list_filter(ts, lambda x: x = t.term)) AS tf FROM w, (VALUES ('and'), ('in'), ('of'), ('the')) t(term)),
f AS (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY term),
s AS (SELECT id, lang, sum(ln(1.0 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / average))) AS score FROM p JOIN f USING (term), n WHERE tf > 0 GROUP BY id, lang)"""
_RANKED = "SELECT id, score, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, id) AS INT) AS rank FROM s"
_SQ8 = """c AS (SELECT id, v, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) = 0 THEN 1.0 ELSE list_max(list_transform(v, lambda x: abs(x))) / 127.0 END AS scale FROM e),
k AS (SELECT id, v, scale, list_transform(v, lambda x: greatest(-127, least(127, round(x / scale)))) AS codes FROM c)"""
_MUT = "m AS (SELECT event_id // 100 AS seq, CAST(event_id % 100 AS INT) AS ordinal, CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'put' END AS op, user_id AS id, value FROM events)"

ORACLE_SQL = {
    "knn_l2": _knn_sql("l2"), "knn_cosine": _knn_sql("cos"), "knn_ip": _knn_sql("ip"), "knn_k_zero": _knn_sql("cos", 0), "knn_k_over": _knn_sql("l2", 100_000),
    "knn_filtered": _knn_sql("l2", where="e.label = 1"), "knn_ids": _knn_sql("cos", where="e.id % 7 = 0"), "knn_metadata": _knn_sql("ip", 5, "e.label = 2"),
    "knn_multi_query": f"""WITH {_E}, q AS (SELECT id AS qid, v FROM e WHERE id % 20 = 0), d AS (SELECT qid, e.id, {_DIST['l2']} AS d FROM e, q),
r AS (SELECT qid, id, d, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, id) AS INT) AS rank FROM d) SELECT qid, id, round(d, 9) AS distance, rank FROM r WHERE rank <= 10""",
    "auto_reasons": f"""WITH {_E}, {_SQ8}, n AS (SELECT *, list_inner_product(codes, codes) AS nn FROM k), qc AS (SELECT codes AS qc, scale AS qs, nn AS qn FROM n WHERE id = 0), q AS (SELECT v FROM e WHERE id = 0),
s(item, reason, k, every) AS (VALUES (1, 'AnnSelected', 10, 1), (2, 'LargeK', 200, 1), (3, CASE WHEN (SELECT count(*) FROM e) > 80 THEN 'SelectiveFilter' ELSE 'SmallEligibleSet' END, 10, 20), (4, 'SmallEligibleSet', 10, 50)),
a AS (SELECT n.id FROM n, qc ORDER BY greatest(0.0, n.scale * n.scale * n.nn + qs * qs * qn - 2.0 * n.scale * qs * list_inner_product(codes, qc)), n.id LIMIT 128),
d AS (SELECT item, reason, k, e.id, {_DIST['l2']} AS d, (SELECT count(*) FROM e x WHERE x.id % every = 0) AS eligible FROM s, e, q WHERE e.id % every = 0 AND (item <> 1 OR e.id IN (SELECT id FROM a))),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY d, id) AS INT) AS rank FROM d) SELECT item, reason, eligible, id, round(d, 9) AS distance, rank FROM r WHERE rank <= k""",
    "pairwise_distances": f"WITH {_E}, q AS (SELECT v FROM e WHERE id = 1) SELECT e.id, round({_DIST['l2']}, 9) AS squared_l2, round({_DIST['cos']}, 9) AS cosine, round({_DIST['ip']}, 9) AS inner_product FROM e, q",
    "tokens": f"SELECT doc_id AS id, CAST(len({_TERMS}) AS BIGINT) AS len FROM documents",
    "term_stats": f"WITH x AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM x GROUP BY term",
    "bm25": f"WITH {_BM25}, r AS ({_RANKED}) SELECT id, round(score, 9) AS score, rank FROM r WHERE rank <= 20",
    "bm25_filtered": f"WITH {_BM25}, r AS ({_RANKED} WHERE lang = 'en') SELECT id, round(score, 9) AS score, rank FROM r WHERE rank <= 20",
    "bm25_counters": f"WITH {_BM25} SELECT (SELECT count(*) FROM w WHERE lang = 'en') AS eligible, (SELECT count(*) FROM s WHERE lang = 'en') AS matching, (SELECT count(*) FROM p WHERE tf > 0) AS postings_visited",
    "hybrid_rrf": f"""WITH {_E}, {_BM25.replace('FROM documents)', 'FROM documents WHERE doc_id IN (SELECT id FROM e))')}, q AS (SELECT v FROM e WHERE id = 0),
d AS (SELECT e.id, {_DIST['cos']} AS d FROM e JOIN documents x ON x.doc_id = e.id AND x.lang = 'en', q),
a AS (SELECT id, d, CAST(row_number() OVER (ORDER BY d, id) AS INT) AS r FROM d QUALIFY r <= 64),
b AS (SELECT id, score, rank AS r FROM ({_RANKED} WHERE lang = 'en') WHERE rank <= 64),
g AS (SELECT coalesce(a.id, b.id) AS id, a.r AS vector_rank, a.d, b.r AS keyword_rank, b.score AS ks, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS s FROM a FULL JOIN b ON a.id = b.id)
SELECT id, vector_rank, round(d, 9) AS distance, keyword_rank, round(ks, 9) AS keyword_score, round(s, 12) AS score, CAST(row_number() OVER (ORDER BY s DESC, id) AS INT) AS rank FROM g QUALIFY rank <= 10""",
    "context_chunks": """WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id AS s, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id * 1000 + turn) AS INT) AS rn FROM conversations)
SELECT c.id AS centre, x.rn - c.rn AS position, x.id FROM t c JOIN t x ON c.s = x.s AND abs(c.rn - x.rn) <= 2 WHERE c.id % 5 = 0 AND c.role = 'user' AND x.role = 'user'""",
    "group_by_source": f"WITH {_BM25}, r AS (SELECT * FROM ({_RANKED}) WHERE rank <= 100), x AS (SELECT r.id, d.source, r.rank, row_number() OVER (PARTITION BY d.source ORDER BY r.rank) AS n FROM r JOIN documents d ON d.doc_id = r.id) SELECT id, source, rank FROM x WHERE n = 1",
    "max_distance": f"SELECT * FROM ({_knn_sql('cos', 50)}) WHERE distance <= 0.7",
    "list_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 64",
    "sq8_encode": f"WITH {_E}, {_SQ8} SELECT id, CAST(list_sum(list_transform(codes, lambda x: x * x)) AS BIGINT) AS sqnorm, round(scale, 12) AS scale FROM k",
    "sq8_search": f"""WITH {_E}, {_SQ8}, n AS (SELECT *, list_inner_product(codes, codes) AS nn FROM k), q AS (SELECT codes AS qc, scale AS qs, nn AS qn, v FROM n WHERE id = 0),
a AS (SELECT n.id, n.v, greatest(0.0, n.scale * n.scale * n.nn + qs * qs * qn - 2.0 * n.scale * qs * list_inner_product(codes, qc)) AS near FROM n, q ORDER BY near, id LIMIT 64),
r AS (SELECT e.id, {_DIST['l2']} AS d FROM a e, q) SELECT id, round(d, 9) AS distance, CAST(row_number() OVER (ORDER BY d, id) AS INT) AS rank FROM r QUALIFY rank <= 10""",
    "sq8_many": f"""WITH {_E}, {_SQ8}, n AS (SELECT *, list_inner_product(codes, codes) AS nn FROM k), q AS (SELECT id AS qid, codes AS qc, scale AS qs, nn AS qn, v FROM n WHERE id % 20 = 0),
a AS (SELECT qid, n.id, {_DIST['l2'].replace('e.v', 'n.v')} AS d, row_number() OVER (PARTITION BY qid ORDER BY greatest(0.0, n.scale * n.scale * n.nn + qs * qs * qn - 2.0 * n.scale * qs * list_inner_product(codes, qc)), n.id) AS place FROM n, q),
r AS (SELECT qid, id, d, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, id) AS INT) AS rank FROM a WHERE place <= 64) SELECT qid, id, round(d, 9) AS distance, rank FROM r WHERE rank <= 10""",
    "recall_sq8": f"""WITH {_E}, {_SQ8}, n AS (SELECT *, list_inner_product(codes, codes) AS nn FROM k), q AS (SELECT id AS qid, codes AS qc, scale AS qs, nn AS qn, v FROM n WHERE id % 20 = 0),
a AS (SELECT qid, n.id, {_DIST['l2'].replace('e.v', 'n.v')} AS d, row_number() OVER (PARTITION BY qid ORDER BY greatest(0.0, n.scale * n.scale * n.nn + qs * qs * qn - 2.0 * n.scale * qs * list_inner_product(codes, qc)), n.id) AS place FROM n, q),
t AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM a QUALIFY rank <= 10), f AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM a WHERE place <= 64 QUALIFY rank <= 10),
h AS (SELECT t.qid, count(*) AS wanted, count(f.id) AS hits FROM t LEFT JOIN f ON t.qid = f.qid AND t.id = f.id GROUP BY t.qid)
SELECT count(*) AS queries, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits) / sum(wanted), 9) AS recall, count(*) FILTER (wanted < 10) AS short FROM h""",
    "sq8_all_candidates": _knn_sql("cos"),
    "sync_plan": """WITH o AS (SELECT conv_id * 1000 + turn AS id, 'c' || conv_id || '.md' AS source, text, turn FROM conversations), i AS (SELECT id, source, CASE WHEN id % 13 = 0 THEN text || '!' ELSE text END AS text, turn FROM o WHERE id % 7 <> 0 AND id % 1000 <> 3),
a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS p FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, id) AS p FROM i),
j AS (SELECT coalesce(a.source, b.source) AS source, a.id, b.id AS nid, a.text AS t, b.text AS nt, a.turn AS l, b.turn AS nl FROM a FULL JOIN b ON a.source = b.source AND a.p = b.p),
k AS (SELECT *, bool_and(coalesce(t = nt AND l = nl, FALSE)) OVER (PARTITION BY source) AS same, bool_or(nid IS NOT NULL) OVER (PARTITION BY source) AS known FROM j),
x AS (SELECT *, CASE WHEN same THEN 'unchanged' WHEN NOT known OR nid IS NULL THEN 'delete' WHEN id IS NULL THEN 'insert' ELSE 'update' END AS action FROM k),
y AS (SELECT *, action IN ('insert', 'update') AS put, EXISTS (SELECT 1 FROM o WHERE o.source = x.source AND o.text = x.nt AND o.turn = x.nl) AS again FROM x),
z AS (SELECT source, bool_or(action <> 'unchanged') AS changed, count(*) FILTER (put) AS puts, count(*) FILTER (action = 'delete') AS deletes, count(*) FILTER (put AND again) AS reused FROM y GROUP BY source)
SELECT count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS unchanged, CAST(sum(puts) AS BIGINT) AS puts, CAST(sum(deletes) AS BIGINT) AS deleted, CAST(sum(reused) AS BIGINT) AS reused, CAST(sum(puts) - sum(reused) AS BIGINT) AS embed FROM z""",
    "mutation_fold": f"WITH {_MUT}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, ordinal DESC) AS n FROM m) SELECT id, value FROM r WHERE n = 1 AND op = 'put'",
    "batch_report": f"""WITH {_MUT}, x AS (SELECT m.*, coalesce(lag(op) OVER (PARTITION BY m.id ORDER BY seq, ordinal), CASE WHEN m.id < 50 THEN 'put' ELSE 'delete' END) = 'put' AS there FROM m)
SELECT seq, count(*) FILTER (op = 'put' AND NOT there) AS inserted, count(*) FILTER (op = 'put' AND there) AS updated, count(*) FILTER (op = 'delete' AND there) AS deleted, count(*) FILTER (op = 'delete' AND NOT there) AS absent FROM x GROUP BY seq""",
    "store_stats": "SELECT count(*) AS rows, CAST(sum(len(embedding) * 4) AS BIGINT) AS vector_bytes, CAST(min(len(embedding)) AS INT) AS min_dims, CAST(max(len(embedding)) AS INT) AS max_dims FROM embeddings",
    "doctor": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 7 = 0) AS a, count(*) FILTER (vec_id % 11 = 0) AS b, count(*) FILTER (vec_id % 13 = 0) AS z, count(*) FILTER (vec_id % 17 = 0) AS s, count(*) FILTER (vec_id % 19 = 0) AS u, count(*) FILTER (vec_id % 23 = 0) AS i FROM embeddings)
SELECT n + a + b + z + s + u + i AS rows, a + i - 1 AS repeated_ids, i AS null_ids, b AS not_finite, s + u AS wrong_dimensions, z AS zero_vectors FROM c""",
    "bm25_indexed": f"WITH {_BM25}, r AS ({_RANKED}) SELECT id, round(score, 9) AS score, rank FROM r WHERE rank <= 20",
    "bm25_indexed_filtered": f"WITH {_BM25}, r AS ({_RANKED} WHERE lang = 'en') SELECT id, round(score, 9) AS score, rank FROM r WHERE rank <= 20",
    "index_postings": f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0), x AS (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM d), p AS (SELECT term, doc_id, l, count(*) AS tf FROM x GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, CAST(sum(l) AS BIGINT) AS lens FROM p GROUP BY term""",
    "ivf_all_cells": _knn_sql("cos", where="e.label = 1"),
    "knn_null_vectors": f"""WITH {_E}, q AS (SELECT id AS qid, v FROM e WHERE id % 20 = 0), d AS (SELECT qid, e.id, {_DIST['cos']} AS d FROM e, q WHERE e.id % 3 <> 1 AND e.id % 9 <> 2 AND e.id % 9 <> 5),
r AS (SELECT qid, id, d, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, id) AS INT) AS rank FROM d) SELECT qid, id, round(d, 9) AS distance, rank FROM r WHERE rank <= 5""",
    "latency_percentiles": "SELECT CAST(quantile_disc(l_extendedprice, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(l_extendedprice, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(l_extendedprice, 0.99) AS DOUBLE) AS p99 FROM lineitem",
    "rerank_hits": f"SELECT * FROM (SELECT id, CAST(row_number() OVER (ORDER BY id % 7, id) AS INT) AS rank FROM (SELECT id FROM ({_knn_sql('l2', 30)}))) WHERE rank <= 10",
    "korean_terms": """WITH d AS (SELECT doc_id, translate(CAST(doc_id % 1000 AS VARCHAR), '0123456789', '가나다라마바사아자차') AS w FROM documents),
g AS (SELECT doc_id, w AS term FROM d UNION ALL SELECT doc_id, '백업' FROM d UNION ALL SELECT doc_id, unnest(list_distinct(list_filter([substr(w, 1, 2), substr(w, 2, 2)], lambda x: length(x) = 2 AND x <> w))) FROM d)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM g GROUP BY term""",
    "bm25_no_match": "SELECT doc_id AS id, CAST(0 AS DOUBLE) AS score, CAST(0 AS INT) AS rank FROM documents WHERE FALSE",
    "one_source_each": f"""WITH {_E}, q AS (SELECT v FROM e WHERE id = 0), d AS (SELECT e.id, e.label AS source, {_DIST['l2']} AS d FROM e, q), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d, id) AS n FROM d)
SELECT id, source, round(d, 9) AS distance, CAST(row_number() OVER (ORDER BY d, id) AS INT) AS rank FROM b WHERE n = 1 QUALIFY rank <= 3""",
    "mrr_ndcg": f"""WITH {_E}, q AS (SELECT id AS qid, v, label FROM e WHERE id % 20 = 0), d AS (SELECT qid, e.id, e.label AS source, {_DIST['cos']} AS d FROM e, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM d QUALIFY rank <= 10),
f AS (SELECT * FROM r WHERE id <> qid), j AS (SELECT qid, CASE WHEN qid % 10 <> 0 THEN label END AS expected FROM q), b AS (SELECT j.qid, expected, (SELECT min(rank) FROM f WHERE f.qid = j.qid AND f.source = j.expected) AS r, (SELECT count(*) FROM f WHERE f.qid = j.qid) > 0 AS back FROM j)
SELECT count(*) AS queries, count(expected) AS answerable, round(avg(CASE WHEN expected IS NOT NULL THEN CAST(coalesce(r = 1, FALSE) AS INT) END), 9) AS hit_at_1, round(avg(CASE WHEN expected IS NOT NULL THEN CAST(coalesce(r <= 3, FALSE) AS INT) END), 9) AS recall_at_3,
round(avg(CASE WHEN expected IS NOT NULL THEN coalesce(1.0 / r, 0) END), 9) AS mrr, round(avg(CASE WHEN expected IS NOT NULL THEN coalesce(1.0 / log2(r + 1), 0) END), 9) AS ndcg, round(avg(CASE WHEN expected IS NOT NULL THEN CAST(r IS NOT NULL AS INT) END), 9) AS source_recall,
count(*) FILTER (expected IS NULL AND back) AS unanswerable_returned FROM b""",
    **{name: f"SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE {sql}" for name, (_, sql) in FILTERS.items()},
}
ORACLE_SQL["sq8_prepared"] = ORACLE_SQL["sq8_search"]
