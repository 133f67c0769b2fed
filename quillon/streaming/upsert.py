"""A stream of mutations applied to a store, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Metric
from ..operators.store import Store
from ..plans import knn


def upsert(stream: DataFrame, store: Store, checkpoint: str, name: str = "upsert") -> StreamingQuery:
    """stream (ordinal, op, id, columns): every micro-batch is one batch of the store; one that is replayed has no effect."""

    def apply(batch: DataFrame, number: int) -> None:
        store.write_batch(batch, batch_id=f"{name}-{number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parse_requests(lines: DataFrame) -> DataFrame:
    """JSON request lines (value) -> (qid, vector, k, error): a bad line gives an error instead of ending the stream."""
    r = F.from_json("value", "qid bigint, vector array<float>, k int")
    bad = r.isNull() | r["qid"].isNull() | r["vector"].isNull() | r["k"].isNull() | (r["k"] < 0)
    return lines.select(r["qid"].alias("qid"), r["vector"].alias("vector"), r["k"].alias("k"), F.when(bad, F.lit("InvalidInput")).alias("error"))


def answers(lines: DataFrame, corpus: DataFrame, metric: Metric) -> DataFrame:
    """(qid, id, distance, rank, error) for request lines: the k nearest rows of each good request, a row with an error for each bad one."""
    asked = parse_requests(lines)
    good = asked.where("error is null")
    most = good.agg(F.max("k")).first()[0] or 0
    hits = knn.many(corpus, good.select("qid", "vector"), most, metric)
    kept = hits.join(good.select("qid", "k"), "qid").where(F.col("rank") <= F.col("k"))
    bad = asked.where("error is not null").select("qid", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank"), "error")
    return kept.select("qid", "id", "distance", "rank", F.lit(None).cast("string").alias("error")).union(bad)


def serve(stream: DataFrame, corpus: DataFrame, metric: Metric, out: str, checkpoint: str) -> StreamingQuery:
    """A session: request lines (value) come in, answers go to JSON files below out."""

    def apply(batch: DataFrame, number: int) -> None:
        answers(batch, corpus, metric).write.mode("overwrite").json(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
