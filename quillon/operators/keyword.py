"""BM25 keyword search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import invalid
from ..files import Files
from ..functions.text import WORDS, check_query, terms, words

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str = "id", text: str = "text", analyzer: str = WORDS) -> DataFrame:
    """(term, id, tf)."""
    each = docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text), analyzer)).alias("term"))
    return each.groupBy("term", "id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, len): words of each document, whatever the analyzer."""
    return docs.select(F.col(id_col).alias("id"), F.size(words(F.col(text))).cast("long").alias("len"))


def term_stats(docs: DataFrame, id_col: str = "id", text: str = "text", analyzer: str = WORDS) -> DataFrame:
    """(term, df, total)."""
    return postings(docs, id_col, text, analyzer).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def query_terms(docs: DataFrame, query: str, analyzer: str = WORDS) -> list[str]:
    """The query's different terms, in order."""
    check_query(query)
    one = docs.sparkSession.range(1).select(F.array_sort(F.array_distinct(terms(F.lit(query), analyzer))).alias("t"))
    return one.first()["t"]


def _hits(docs: DataFrame, asked: list[str], id_col: str, text: str, analyzer: str, where: Column | None) -> DataFrame:
    """One row per document: id, len, tfs of the asked terms, and whether it is eligible.  One pass, nothing is shuffled."""
    one = lambda c: F.explode(F.array(c))  # noqa: E731  a generator's value is made once, whatever uses it
    tokens = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), (F.lit(True) if where is None else where).alias("eligible"), one(words(F.col(text))).alias("words"))
    if analyzer == WORDS:
        tokens = tokens.withColumn("terms", F.col("words"))
    else:
        tokens = tokens.select("*", one(terms(F.col("text"), analyzer)).alias("terms"))
    tokens = tokens.select("id", F.size("words").cast("long").alias("len"), "eligible", "terms")
    times = lambda t: F.size(F.filter("terms", lambda w: w == t))
    tfs = F.array(*map(times, asked)) if asked else F.array().cast("array<int>")
    return tokens.select("id", "len", "eligible", tfs.alias("tfs"))


def search(docs: DataFrame, query: str, k: int, id_col: str = "id", text: str = "text", analyzer: str = WORDS, where: Column | None = None) -> DataFrame:
    """(id, score, rank), at most k rows by score descending, then id.

    Document counts, frequencies and lengths are those of all docs, also where only some are eligible.  A document's terms are
    added in sorted order, so scores are the same bits every time.
    """
    if k < 0:
        raise invalid("k must not be negative")
    asked = query_terms(docs, query, analyzer)
    hits = _hits(docs, asked, id_col, text, analyzer, where)
    stats = hits.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"), *[F.count_if(F.col("tfs")[i] > 0).alias(f"df{i}") for i in range(len(asked))]).first()
    n, total = stats["n"], stats["total"]
    order = (F.desc("score"), F.asc("id"))
    if not asked or not total:
        return hits.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    score = _score([stats[f"df{i}"] for i in range(len(asked))], n, total)
    found = hits.where("eligible").where(F.exists("tfs", lambda x: x > 0)).select("id", score.alias("score"))
    return found.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _score(dfs: list[int], n: int, total: int) -> Column:
    """Score of a row (len, tfs) for terms that dfs of n documents with total words hold."""
    average, score = total / n, F.lit(0.0)
    for i, df in enumerate(dfs):
        idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
        tf = F.col("tfs")[i].cast("double")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / average))
        score = score + F.when(tf > 0, part).otherwise(0.0)
    return score


class Index:
    """An inverted index on disk: postings (term, id, tf, len) in order of term, so that a query reads its terms' pages only.

    A change is a segment: its documents' postings, and a row (id, len) for each of them, len null where one was removed.  Of a
    document the last segment counts.  `merge` makes one segment of all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)
        self.state = self.files.read("index.json")

    @classmethod
    def create(cls, spark: SparkSession, path: str, analyzer: str = WORDS) -> Index:
        Files(spark, path).create("index.json", {"analyzer": analyzer, "segments": [], "next": 0})
        return cls(spark, path)

    def _read(self, table: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{table}-{s}").withColumn("seg", F.lit(s)) for s in self.state["segments"]]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], f"{schema}, seg int")

    def documents(self) -> DataFrame:
        """(id, len, seg) of what is indexed now."""
        rows = self._read("documents", "id long, len long")
        if len(self.state["segments"]) > 1:
            rows = rows.groupBy("id").agg(F.max_by("len", "seg").alias("len"), F.max("seg").alias("seg"))
        return rows.where("len is not null")

    def add(self, docs: DataFrame, removed: DataFrame | None = None, id_col: str = "id", text: str = "text") -> None:
        """One more segment: docs replace those of their ids; ids in removed (one column) go."""
        seg = self.state["next"]
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
        gone = rows.select("id", F.lit(None).cast("long").alias("len")).limit(0) if removed is None else removed.select(F.col(removed.columns[0]).cast("long").alias("id"), F.lit(None).cast("long").alias("len"))
        each, lens = self._counted(rows, seg)
        self._write(each, lens.union(gone.join(rows.select("id"), "id", "left_anti")), seg)
        self.files.delete(f"counted-{seg}")
        self._commit([*self.state["segments"], seg], seg + 1)

    def _counted(self, rows: DataFrame, seg: int) -> tuple[DataFrame, DataFrame]:
        """Postings (term, id, tf, len) and lengths (id, len) of rows (id, text).

        A text is cut into words once and its terms are counted in its row, so that no word is shuffled before the sort; the
        counts are written, as the sort reads them twice.
        """
        one = lambda c: F.explode(F.array(c))  # noqa: E731  a generator's value is made once, whatever uses it
        cut = rows.select("id", "text", one(words(F.col("text"))).alias("words"))
        if self.state["analyzer"] == WORDS:
            cut = cut.withColumn("terms", F.col("words"))
        else:
            cut = cut.select("*", one(terms(F.col("text"), self.state["analyzer"])).alias("terms"))
        cut = cut.select("id", F.size("words").cast("long").alias("len"), one(F.array_sort("terms")).alias("terms"))
        n = F.size("terms")
        place = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(place, lambda i: (i == n - 1) | (F.get("terms", i) != F.get("terms", i + 1)))
        marked = cut.select("id", "len", "terms", one(ends).alias("ends"))
        runs = F.transform("ends", lambda e, i: F.struct(F.get("terms", e).alias("term"), (e - F.when(i == 0, -1).otherwise(F.get("ends", i - 1))).cast("long").alias("tf")))
        path = f"{self.path}/counted-{seg}"
        marked.select("id", "len", runs.alias("runs")).write.mode("overwrite").parquet(path)
        kept = self.spark.read.schema("id long, len long, runs array<struct<term:string,tf:long>>").parquet(path)
        return kept.select("id", "len", F.inline("runs")).select("term", "id", "tf", "len"), kept.select("id", "len")

    def merge(self) -> None:
        """One segment of all."""
        seg, live = self.state["next"], self.documents()
        rows = self._read("postings", "term string, id long, tf long, len long").join(live.select("id", "seg"), ["id", "seg"], "left_semi")
        self._write(rows.drop("seg"), live.select("id", "len"), seg)
        old = self.state["segments"]
        self._commit([seg], seg + 1)
        for s in old:
            self.files.delete(f"postings-{s}")
            self.files.delete(f"documents-{s}")

    def _write(self, rows: DataFrame, lens: DataFrame, seg: int) -> None:
        rows.select("term", "id", "tf", "len").orderBy("term", "id").write.mode("overwrite").parquet(f"{self.path}/postings-{seg}")
        lens.write.mode("overwrite").parquet(f"{self.path}/documents-{seg}")

    def _commit(self, segments: list[int], next_: int) -> None:
        self.state |= {"segments": segments, "next": next_}
        live = self.documents().agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        self.state |= {"n": live[0], "total": live[1]}
        self.files.replace("index.json", self.state)

    def _postings(self, asked: list[str]) -> DataFrame:
        rows = self._read("postings", "term string, id long, tf long, len long").where(F.col("term").isin(asked))
        if len(self.state["segments"]) > 1:
            rows = rows.join(self.documents().select("id", "seg"), ["id", "seg"], "left_semi")
        return rows

    def search(self, query: str, k: int, eligible: DataFrame | None = None) -> DataFrame:
        """(id, score, rank) as search gives it; with eligible, only ids of its first column."""
        if k < 0:
            raise invalid("k must not be negative")
        check_query(query)
        one = self.spark.range(1).select(F.array_sort(F.array_distinct(terms(F.lit(query), self.state["analyzer"]))).alias("t"))
        asked = one.first()["t"]
        rows = self._postings(asked)
        if not asked or not self.state.get("total"):
            return rows.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        dfs = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row a term
        each = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)) for t in asked]
        hits = rows.groupBy("id").agg(F.first("len").alias("len"), F.array(*each).alias("tfs"))
        if eligible is not None:
            hits = hits.join(eligible.select(F.col(eligible.columns[0]).cast("long").alias("id")), "id", "left_semi")
        score = _score([dfs.get(t, 0) for t in asked], self.state["n"], self.state["total"])
        order = (F.desc("score"), F.asc("id"))
        return hits.select("id", score.alias("score")).orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def counters(docs: DataFrame, query: str, id_col: str = "id", text: str = "text", analyzer: str = WORDS, where: Column | None = None) -> DataFrame:
    """One row: eligible documents, matching ones among them, postings visited (of ineligible documents too)."""
    hits = _hits(docs, query_terms(docs, query, analyzer), id_col, text, analyzer, where)
    has = F.exists("tfs", lambda x: x > 0)
    visited = F.coalesce(F.sum(F.size(F.filter("tfs", lambda x: x > 0)).cast("long")), F.lit(0).cast("long"))
    return hits.agg(F.count_if(F.col("eligible")).alias("eligible"), F.count_if(F.col("eligible") & has).alias("matching"), visited.alias("postings_visited"))
