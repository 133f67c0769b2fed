"""Plans what an incremental import changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(stored: DataFrame, incoming: DataFrame, prune: bool = False, formats: tuple[str, ...] = (".md",)) -> DataFrame:
    """(source, position, action, id, reuse): what makes stored (id, source, text, start_line, end_line, tags) equal incoming.

    Sources whose chunks are the same in order are `unchanged`; else ids are used again by position (`update`), new chunks
    are `insert` (id null, drawn later), and surplus ids `delete`.  reuse is the id of a stored chunk of the source with the
    same text and lines, whose vector serves.  Sources that are missing from incoming go only with prune, and only if their
    name ends in one of the formats that were read.
    """
    content = ("text", "start_line", "end_line", "tags")
    number = lambda df, *order: df.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy(*order)))
    old = number(stored, "id").select("source", "position", "id", F.xxhash64(*content).alias("o"), F.xxhash64("text", "start_line", "end_line").alias("v"))
    new = number(incoming, "start_line", "end_line", "chunk").select("source", "position", F.xxhash64(*content).alias("c"), F.xxhash64("text", "start_line", "end_line").alias("w"))
    both = old.join(new, ["source", "position"], "full_outer")
    by_source = Window.partitionBy("source")
    seen = both.withColumns({"same": F.min(F.coalesce(F.col("o") == F.col("c"), F.lit(False))).over(by_source), "known": F.max(F.col("c").isNotNull()).over(by_source)})
    ends = F.lit(False)
    for f in formats:
        ends = ends | F.lower("source").endswith(f)
    action = F.when(F.col("same"), "unchanged").when(~F.col("known"), F.when(F.lit(prune) & ends, "delete").otherwise("keep")).when(F.col("c").isNull(), "delete").when(F.col("o").isNull(), "insert").otherwise("update")
    vectors = old.groupBy("source", F.col("v").alias("w")).agg(F.min("id").alias("reuse"))
    return seen.withColumn("action", action).join(vectors, ["source", "w"], "left").select("source", "position", "action", "id", F.when(F.col("action").isin("insert", "update"), F.col("reuse")).alias("reuse"))


def report(planned: DataFrame) -> DataFrame:
    """One row: sources changed and unchanged, chunks put, deleted, reusing a vector and needing one."""
    a = F.col("action")
    puts = a.isin("insert", "update")
    by = planned.groupBy("source").agg(F.max(a.isin("insert", "update", "delete")).alias("changed"), F.count_if(puts).alias("puts"), F.count_if(a == "delete").alias("deletes"), F.count_if(puts & F.col("reuse").isNotNull()).alias("reused"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by.agg(F.count_if(F.col("changed")).alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"), total("puts").alias("puts"), total("deletes").alias("deleted"), total("reused").alias("reused"), (total("puts") - total("reused")).alias("embed"))
