import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillon.config import HybridOptions, Metric
from quillon.errors import EngineError
from quillon.functions import text
from quillon.operators import filters, keyword
from quillon.plans import hybrid
from quillon.sources import ingest

RIVERS = ["danube", "loire", "tagus", "volga", "oder"]


@pytest.fixture(scope="module")
def shelf(spark):
    """Books of a small library: some without a weight, some without a day of purchase."""
    rng = random.Random(99)
    rows = []
    for i in range(90):
        weight = {"weight": rng.choice([0.5, 1.25, 2.0, 3.75])} if rng.random() < 0.7 else {}
        bought = {"bought": date(2031, rng.randrange(1, 13), rng.randrange(1, 28))} if rng.random() < 0.6 else {}
        rows.append((i, " ".join(rng.choices(RIVERS, k=rng.randrange(0, 9))), f"room/{rng.choice('abcde')}", sorted(rng.sample(["blue", "old", "torn"], rng.randrange(3))), weight, bought))
    df = spark.createDataFrame(rows, "id long, text string, source string, tags array<string>, numbers map<string,double>, dates map<string,date>").cache()
    return df, {r[0]: r for r in rows}


def leaves(row):
    """Every leaf with a plain Python test of the same meaning."""
    _, _, source, tags, numbers, dates = row
    w, d = numbers.get("weight"), dates.get("bought")
    mid = date(2031, 6, 15)
    return [
        (filters.Source("room/b"), source == "room/b"),
        (filters.Tag("torn"), "torn" in tags),
        (filters.Range("number", "weight", (1.25, True), None), w is not None and w >= 1.25),
        (filters.Range("number", "weight", None, (2.0, False)), w is not None and w < 2.0),
        (filters.Range("number", "height", (0.0, True), None), False),
        (filters.Range("date", "bought", (mid, False), None), d is not None and d > mid),
        (filters.Range("date", "bought", (date(2031, 2, 1), True), (mid, True)), d is not None and date(2031, 2, 1) <= d <= mid),
    ]


def grown(rng, row, depth):
    """A random tree, made alike for every row by the same seed, with what it says of this row."""
    kind = rng.randrange(4) if depth else 3
    if kind == 3:
        return leaves(row)[rng.randrange(7)]
    parts = [grown(rng, row, depth - 1) for _ in range(1 if kind == 2 else rng.randrange(4))]
    if kind == 2:
        return filters.Not(parts[0][0]), not parts[0][1]
    return (filters.And, filters.Or)[kind](tuple(p for p, _ in parts)), (all, any)[kind](v for _, v in parts)


def test_filters_mean_what_plain_tests_say(shelf):
    df, rows = shelf
    seeds = range(300, 330)
    trees = [grown(random.Random(s), rows[0], 3)[0] for s in seeds]
    for got in df.select("id", *[filters.column(t).alias(f"t{k}") for k, t in enumerate(trees)]).collect():
        assert [got[f"t{k}"] for k in range(len(trees))] == [grown(random.Random(s), rows[got["id"]], 3)[1] for s in seeds]


@pytest.mark.parametrize(
    ("said", "tree"),
    [
        ('tag("blue") and (source("room/a") or not tag("old"))', filters.And((filters.Tag("blue"), filters.Or((filters.Source("room/a"), filters.Not(filters.Tag("old"))))))),
        ('number("weight") < 7.5', filters.Range("number", "weight", None, (7.5, False))),
        ('number("weight") = 2', filters.Range("number", "weight", (2.0, True), (2.0, True))),
        ('date("bought") > "2031-05-06"', filters.Range("date", "bought", (date(2031, 5, 6), False), None)),
        (r'source("two\nlines \"quoted\" ñ")', filters.Source('two\nlines "quoted" ñ')),
        ('number("weight") != -3', filters.Not(filters.Range("number", "weight", (-3.0, True), (-3.0, True)))),
    ],
)
def test_language(said, tree):
    assert filters.parse(said) == tree


@pytest.mark.parametrize("said", ["", "blue", "tag()", 'tag("blue"', 'tag("blue") tag("old")', 'and tag("blue")', 'number("weight") ~ 3', 'number("weight") < infinity', 'date("bought") = "2031-02-30"', r'source("\z")', "(" * 40 + 'tag("a")' + ")" * 40])
def test_language_rejects(said):
    with pytest.raises(EngineError):
        filters.parse(said)


def test_empty_ranges_are_invalid():
    with pytest.raises(EngineError):
        filters.validate(filters.Range("number", "weight", (9.0, False), (8.0, False)))


def bm25(texts, asked, k1=1.2, b=0.75):
    """The formula, from the words."""
    words = {i: (t or "").split() for i, t in texts.items()}
    average = sum(map(len, words.values())) / len(words)
    out = {}
    for i, ws in words.items():
        score = 0.0
        for term in sorted(set(asked)):
            df = sum(term in x for x in words.values())
            tf = ws.count(term)
            score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / average)) if tf else 0.0
        if any(t in ws for t in asked):
            out[i] = score
    return out


def test_bm25_follows_the_formula(spark, shelf, tmp_path):
    df, rows = shelf
    texts = {i: r[1] for i, r in rows.items()}
    want = bm25(texts, ["volga", "oder", "nile"])
    got = keyword.search(df, "Volga, ODER! nile volga", 200).collect()
    assert {r["id"] for r in got} == set(want) and all(abs(r["score"] - want[r["id"]]) < 1e-12 for r in got)
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(want, key=lambda i: (-want[i], i))
    torn = F.array_contains("tags", "torn")
    some = {r["id"]: r["score"] for r in keyword.search(df, "volga oder", 200, where=torn).collect()}
    assert set(some) == {i for i in bm25(texts, ["volga", "oder"]) if "torn" in rows[i][3]}
    told = keyword.counters(df, "volga oder", where=torn).first()
    assert told["eligible"] == sum("torn" in r[3] for r in rows.values()) and told["matching"] == len(some)
    assert told["postings_visited"] == sum(term in t.split() for t in texts.values() for term in ("volga", "oder"))
    assert keyword.search(df, "?!", 9).count() == 0 and keyword.search(df.limit(0), "volga", 9).count() == 0

    index = keyword.Index.create(spark, str(tmp_path / "index"))
    index.add(df.where("id % 2 = 0"))
    index.add(df.where("id % 2 = 1"))
    index.add(df.where("id = 4").withColumn("text", F.lit("nile only")), spark.createDataFrame([(6,), (777,)], "id long"))
    texts |= {4: "nile only"}
    del texts[6]
    want = bm25(texts, ["volga", "oder", "nile"])
    for merged in (False, True):
        if merged:
            index.merge()
        got = keyword.Index(spark, str(tmp_path / "index")).search("oder volga nile", 200).collect()
        assert {r["id"] for r in got} == set(want) and all(abs(r["score"] - want[r["id"]]) < 1e-12 for r in got)
    assert {r["id"] for r in index.search("nile", 9, df.where("id < 3").select("id")).collect()} == set()


def test_words_and_grams(spark):
    df = spark.createDataFrame([(1, "snake_case, kebab-case; v2.0 -- ___ Ärger 도서관에"), (2, None), (3, " ")], "id long, text string").orderBy("id")
    assert [r[0] for r in df.select(text.words(F.col("text"))).collect()] == [["snake_case", "kebab-case", "v2", "0", "ärger", "도서관에"], [], []]
    grams = df.select(text.terms(F.col("text"), text.KOREAN_NGRAM)).first()[0]
    assert sorted(g for g in grams if g[0] >= "가") == sorted(["도서관에", "도서", "서관", "관에", "도서관", "서관에"])
    with pytest.raises(EngineError):
        text.terms(F.col("text"), "other")
    with pytest.raises(EngineError):
        text.check_query("nul \0")


def test_fusion_adds_reciprocal_ranks(spark):
    near = spark.createDataFrame([(3, 0.5, 1), (8, 0.75, 2), (1, 2.0, 3)], "id long, distance double, rank int")
    said = spark.createDataFrame([(8, 9.0, 1), (5, 4.0, 2)], "id long, score double, rank int")
    got = {r["id"]: r for r in hybrid.fuse(near, said, 4, HybridOptions(candidates=4, rrf_k=10)).collect()}
    want = {3: 1 / 11, 8: 1 / 12 + 1 / 11, 1: 1 / 13, 5: 1 / 12}
    assert {i: round(r["score"], 12) for i, r in got.items()} == {i: round(s, 12) for i, s in want.items()}
    assert [i for i, r in sorted(got.items(), key=lambda x: x[1]["rank"])] == [8, 3, 5, 1]
    assert got[5]["vector_rank"] is None and got[1]["keyword_score"] is None
    with pytest.raises(EngineError):
        hybrid.fuse(near, said, 5, HybridOptions(candidates=4))


def test_hybrid_search_filters_both_branches(spark):
    df = spark.createDataFrame([(10, "tagus tagus", [9.0]), (11, "loire", [1.0]), (12, "tagus", [2.0]), (13, "tagus", [0.0])], "id long, text string, vector array<float>")
    got = hybrid.search(df, "tagus", [0.0], 9, Metric.SQUARED_L2, HybridOptions(candidates=9), where=F.col("id") < 13).orderBy("id").collect()
    assert [(r["id"], r["vector_rank"], r["keyword_rank"]) for r in got] == [(10, 3, 1), (11, 1, None), (12, 2, 2)]


def test_context_numbers_hidden_chunks_too(spark):
    lines = [(k, "log" if k < 6 else "memo", k, k, k % 3 != 1) for k in range(9)]
    chunks = spark.createDataFrame(lines, "id long, source string, start_line int, end_line int, shown boolean")

    def around(ids, radius):
        centres = spark.createDataFrame([(i,) for i in ids], "id long")
        return sorted((r["centre"], r["position"], r["id"]) for r in hybrid.context(chunks, centres, radius, F.col("shown")).collect())

    assert around([2, 2, 1, 50], 2) == [(2, -2, 0), (2, 0, 2), (2, 1, 3)]
    assert around([5, 6], 1) == [(5, 0, 5), (6, 0, 6)]
    with pytest.raises(EngineError):
        around([2], 99)


def test_pages_groups_and_reranking(spark):
    df = spark.createDataFrame([(i * 3, "xyz"[i % 3], i + 1) for i in range(8)], "id long, source string, rank int")
    seen, after = [], None
    while True:
        rows, after = hybrid.page(df, after, 3)
        seen += [r["id"] for r in rows.collect()]
        if after is None:
            break
    assert seen == [0, 3, 6, 9, 12, 15, 18, 21]
    assert sorted(r["id"] for r in hybrid.first_of_source(df).collect()) == [0, 3, 6]
    assert [r["id"] for r in hybrid.rerank(df, lambda hits: sorted((h["id"] for h in hits), reverse=True), 3, most=5).orderBy("rank").collect()] == [12, 9, 6]
    with pytest.raises(EngineError):
        hybrid.rerank(df, lambda hits: [0], 1)
    asked = []

    def search(n):
        asked.append(n)
        return df.where(F.col("rank") <= n).withColumn("source", F.when(F.col("rank") < 7, "same").otherwise(F.col("source")))

    got, complete = hybrid.one_for_each_source(search, 2, 64)
    assert [(r["id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(0, 1), (18, 2)] and complete and asked == [4, 8]
    got, complete = hybrid.one_for_each_source(search, 4, 6)
    assert got.count() == 1 and not complete


@pytest.mark.parametrize(("query", "mode"), [("where is open_file called", "hybrid"), ("std::vector grows", "hybrid"), ("E1207", "hybrid"), ("why loadConfigFile fails", "hybrid"), ("Backup", "hybrid"), ("how do I write a letter", "vector"), ("한글", "vector"), ("3 apples", "vector"), ("", "vector")])
def test_mode(query, mode):
    assert text.retrieval_mode(query) == mode and text.retrieval_mode(query, "vector") == "vector"


def test_pages_of_html(spark):
    assert ingest.html_text("<head><title>no</title></head><div>one <b>two</b></div>three<ul><li>4<li>5</ul><template>x<p>y</template>&lt;6&gt;") == "one two\nthree\n4\n5\n<6>"
    for empty in ("", "<style>p { color: red }</style>", "<p> \t<br>\n</p>"):
        with pytest.raises(EngineError):
            ingest.html_text(empty)
    df = spark.createDataFrame([(1, "<h1>a</h1>b"), (2, None), (3, " <p> ")], "page_id long, html string")
    assert [r["text"] for r in ingest.extract_html(df).orderBy("page_id").collect()] == ["a\nb", None, None]
