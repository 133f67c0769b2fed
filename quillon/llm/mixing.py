"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected copies are its source's target over the source's size.  The whole part is taken as it is; of the
fractions, two at a time move words between each other, up or down at random so that expectations hold, until one is whole.
The moved words are the same on both sides, so a source's total never changes but for its last fraction.  Groups of a few
dozen documents leave one fraction each, and a reduction tree over groups combines those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashable, n_words, row_of, write_out

WEIGHTS, MAX_COPIES, SEED = (1, 2, 3), 3, 20
#: Fractions that one group of the tree combines, about.
FAN_IN = 64
#: Sources up to this number are broadcast (some MB); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Sources that one task puts in order, about.
RANKED_SOURCES = 1_000_000
_NEAR = 1e-9
#: A document of over one in so many words of its source counts as large.
LARGE = 100


def targets(sized: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, place, source_size, rows, target) of each source of sized(source, size).

    Sources by code point, null last, weigh `weights` in turn and share all sizes; what would pass max_copies times a
    source's size is shared again among the others.
    """
    sums = write_out(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "source-sums")
    ranges = max(1, sums.count() // RANKED_SOURCES)
    order = (F.col("source").isNull(), F.col("source"))
    dealt = write_out(sums.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "source-ranges")
    before, start = F.lit(0).cast("long"), 0
    for r in dealt.groupBy("range").count().orderBy("range").collect():  # one row for RANKED_SOURCES sources
        before, start = F.when(F.col("range") == r["range"], F.lit(start).cast("long")).otherwise(before), start + r["count"]
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + before - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    of = write_out(dealt.withColumn("place", place).drop("range").withColumn("weight", weight), "sources")
    total = of.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * max_copies, 0.0, -1
    while True:  # ends: the capped set only grows
        full = F.col("weight") * F.lit(level) >= cap if capped >= 0 else F.col("source_size") < 0
        n, taken, rest = of.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - taken) / rest
    return of.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))).drop("weight")


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _item(like: Column, p: Column) -> Column:
    return F.struct(like["key"].alias("key"), like["key2"].alias("key2"), like["doc_id"].alias("doc_id"), like["size"].alias("size"), p.alias("p"), like["pool"].alias("pool"))


def _pair(state: Column, x: Column) -> Column:
    """One step: the fraction held and x move words until one of them is whole."""
    c = state["held"]
    down, up = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"]), F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])
    chance = F.xxhash64(c["key"], c["doc_id"], x["key"], x["doc_id"], F.lit(SEED)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    snap = lambda p: F.when(p < _NEAR, 0.0).when(p > 1 - _NEAR, 1.0).otherwise(p)
    whole = lambda p: (p == 0.0) | (p == 1.0)

    def moved(m: Column) -> Column:
        words = F.when(chance * (m["down"] + m["up"]) < m["up"], -m["down"]).otherwise(m["up"])
        return F.array(_item(c, snap(c["p"] + words / c["size"])), _item(x, snap(x["p"] - words / x["size"])))

    def split(both: Column) -> Column:
        open_ = F.filter(both, lambda i: ~whole(i["p"]))
        return F.struct(F.concat(state["done"], F.filter(both, lambda i: whole(i["p"]))).alias("done"), F.get(open_, F.lit(0)).alias("held"))

    pair = _let(F.struct(down.alias("down"), up.alias("up")), lambda m: _let(moved(m), split))
    return F.when(c.isNull(), F.struct(state["done"].alias("done"), x.alias("held"))).otherwise(pair)


_ITEM = "struct<key:bigint,key2:bigint,doc_id:bigint,size:bigint,p:double,pool:boolean>"
_STATE = f"struct<done:array<{_ITEM}>,held:{_ITEM}>"


def round_large(large: DataFrame, pool: DataFrame) -> DataFrame:
    """large(place, key, key2, doc_id, size, p) against pool(place, size, p), the smaller ones together -> (place, s).

    s.done has the large ones that are whole now and s.held what is not; either may hold the pool with its new fraction.
    """
    item = F.struct("key", "key2", "doc_id", "size", "p", F.lit(False).alias("pool"))
    listed = large.groupBy("place").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", item.alias("item"))))).alias("items"))
    met = listed.join(pool.withColumnRenamed("size", "pool_size"), "place")
    held = F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("key2"), F.lit(0).cast("long").alias("doc_id"), F.col("pool_size").alias("size"), F.col("p").alias("p"), F.lit(True).alias("pool"))
    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("done"), held.cast(_ITEM).alias("held"))
    return met.select("place", F.aggregate(F.transform("items", lambda x: x["item"]), start, lambda s, x: _pair(s, x)).alias("s"))


def round_fractions(items: DataFrame, most_groups: int, fan_in: int = FAN_IN) -> DataFrame:
    """items(place, group, key, key2, doc_id, size, p), 0 < p < 1, group < most_groups -> (place, key, key2, doc_id, size, up 0 or 1)."""
    done, groups = [], most_groups
    while True:
        listed = items.groupBy("place", "group").agg(F.array_sort(F.collect_list(F.struct("key", "key2", "doc_id", "size", "p", F.lit(False).alias("pool")))).alias("items"))
        start = F.from_json(F.lit('{"done":[],"held":null}'), _STATE)
        state = F.aggregate("items", start, lambda s, x: _pair(s, x))
        level = write_out(listed.select("place", "group", state.alias("s")), "fractions")
        done.append(level.select("place", F.inline("s.done")))
        held = level.where("s.held is not null").select("place", "group", "s.held.*")
        if groups == 1:
            break
        groups = -(-groups // fan_in)
        items = held.withColumn("group", F.floor(F.col("group") / fan_in))
    draw = F.xxhash64("key", "doc_id", F.lit(SEED + 1)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    last = held.select("place", "key", "key2", "doc_id", "size", F.when(draw < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    parts = [d.select("place", "key", "key2", "doc_id", "size", "p") for d in (*done, last)]
    return reduce(DataFrame.union, parts).withColumn("up", F.col("p").cast("int")).drop("p")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: doc_id, key, key2, source, size, source_size, target, copies, taken = copies x size.

    Size is the number of words, none for null texts; sizes of 0 take no part and have 0 copies.  key and key2 are hashes of all
    columns; rows with equal ones are the same row repeated, and each is mixed by itself.  The null source is a
    source.  Every choice hangs on hashes of rows, so that reruns agree.
    """
    cols = hashable(docs)
    sized = write_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64(*cols).alias("key"), F.xxhash64(F.lit(1), *cols).alias("key2")), "sizes")
    goal = write_out(targets(sized, weights, max_copies), "targets")
    few, most = goal.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    side = F.broadcast(goal) if few <= BROADCAST_SOURCES else goal
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.col("want") - F.floor("want")
    group = F.pmod(F.xxhash64("key", F.lit(SEED)), F.greatest(F.lit(1), F.ceil(F.col("rows") / fan_in)))
    all_ = sized.alias("d").join(side.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("doc_id", "key", "key2", "size", "source_size", "place", group.alias("group"), want.alias("want"))
    all_ = all_.withColumn("p", F.when((part < _NEAR) | (F.col("size") == 0), 0.0).when(part > 1 - _NEAR, 1.0).otherwise(part))
    names = ("place", "key", "key2", "doc_id", "size")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    is_large = open_ & (F.col("size") * LARGE > F.col("source_size"))
    pool = all_.where(open_ & ~is_large).groupBy("place").agg(F.sum("size").alias("size"), F.first("p").alias("p"))
    large = write_out(round_large(all_.where(is_large).select(*names, "p"), pool), "large")  # under LARGE a source
    after = large.select("place", F.inline(F.concat("s.done", F.array_compact(F.array("s.held")))))
    met = after.where("pool").select("place", F.col("p").alias("now"))
    ends = after.where("not pool").join(side.select("place", "rows"), "place").withColumn("group", group).select(*names, "group", "p")
    rest = all_.join(large.select("place", F.lit(True).alias("paired")), "place", "left").where(~is_large | F.col("paired").isNull())
    rest = rest.join(met, "place", "left").withColumn("p", F.when(open_ & ~is_large, F.coalesce("now", "p")).otherwise(F.col("p"))).select(*names, "group", "p")
    ready = write_out(rest.unionByName(ends), "fractions")
    base = ready.where(~open_).select(*names, F.col("p").cast("int").alias("up"))
    rounded = round_fractions(ready.where(open_), max(1, -(-most // fan_in)), fan_in)
    out = base.union(rounded).join(side, "place").withColumn("want", want)
    copies = F.when(F.col("size") > 0, F.floor(F.when(part > 1 - _NEAR, F.floor("want")).otherwise(F.col("want"))) + F.col("up")).otherwise(0).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "key", "key2", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of docs.

    Rows are told apart by 128 bits of hashes of all their columns; of a row that docs repeats, all repetitions' copies are made.
    """
    key = ("key", "key2")
    copies = mix(docs, weights, max_copies).groupBy(*key).agg(F.sum("copies").alias("n"), F.count("*").alias("m"))
    copies = write_out(copies.where("n > 0"), "copies")
    cols = hashable(docs)
    keyed = docs.select(row_of(docs).alias("row"), F.xxhash64(*cols).alias("key"), F.xxhash64(F.lit(1), *cols).alias("key2"))
    met = keyed.join(copies, list(key))
    if copies.where("m > 1").take(1):
        met = met.where("m = 1").unionByName(met.where("m > 1").groupBy(*key).agg(F.first("row").alias("row"), F.first("n").alias("n"), F.first("m").alias("m")))
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("row.*")
