"""Document fingerprints by invertible Bloom lookup sketches of passage digests.

A text's passages (lines, and sentences of a line) are hashed to 64 bits.  A sketch has three rows of cells; a digest goes to one
cell of each row, and a cell keeps the number, the XOR of the digests and the XOR of their check values.  Sketches are linear: the
difference of two holds only what differs.  A cell with a single digest gives it away, it is taken out of its other cells, and so
on.  Two texts are compared by sketches as large as an estimate of their difference asks for; where peeling stops early, both
are sketched again, twice as large and with other hashes, until everything is recovered.  The fingerprint is a sketch of fixed size.

Cells are rows of a table, so that building and peeling are aggregates; they are dealt by ranges of documents once and never move.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, keep_table, let_go, write_out

#: Rows of a sketch, and cells in each row of a fingerprint.
ROWS, WIDTH = 3, 16
#: Cells in a row for each digest of the estimated difference, and cells besides.  Peeling takes rows in turns.
PER_DIGEST, MORE_CELLS, TURNS = 1.0, 8, 3
#: Smallest digests of each text that the estimate compares.
SAMPLE = 16
#: Documents of a range, about, within which each is brought together with the next one; and ranges at most (a range beyond that
#: holds a share of the rows, which one task sorts on disk).
RANGE_ROWS, MAX_RANGES = 256, 1 << 14
_PASSAGE = r"\n|(?<=[.!?]) +"


def digests(text: Column) -> Column:
    """Different passages of a text by their hash, in order; none if it is empty."""
    return F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split(text, _PASSAGE), ""), lambda p: F.xxhash64(p))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7))


def _cell(key: Column, row: int, seed: int) -> Column:
    """Number of a digest's cell in one row of a sketch of w cells a row."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(row)), F.col("w")) + F.col("w") * row


def sketch(rows: DataFrame, by: tuple[str, ...], seed: int) -> DataFrame:
    """rows(by, w, s, key) -> (by, w, c, n, k, x): the cells, but empty ones, of digests added (s 1) and taken away (s -1)."""
    each = rows.select(*by, "w", "s", "key", _check(F.col("key")).alias("check"), F.explode(F.array(*[_cell(F.col("key"), r, seed) for r in range(ROWS)])).alias("c"))
    cells = each.groupBy(*by, "w", "c").agg(F.sum("s").alias("n"), F.bit_xor("key").alias("k"), F.bit_xor("check").alias("x"))
    return cells.where("n <> 0 or k <> 0 or x <> 0")


def peel(cells: DataFrame, by: tuple[str, ...], row: int, seed: int) -> DataFrame:
    """One turn: what is alone in a cell of this row is found, and taken out of its cells of the other rows.

    cells(by, w, c, n, k, x, g) has found digests as rows with c -1, n 1 or -1 and the digest as g; of cells g is 0.  As a digest has
    but one cell in a row, none is found twice in a turn.
    """
    k, w = F.col("k"), F.col("w")
    alone = (F.col("c") >= w * row) & (F.col("c") < w * (row + 1)) & (F.abs("n") == 1) & (F.col("x") == _check(k)) & (F.col("c") == _cell(k, row, seed))
    zero = F.lit(0).cast("long")
    line = lambda c, n, k, x, g: F.struct(c.alias("c"), n.alias("n"), k.alias("k"), x.alias("x"), g.alias("g"))
    out = [line(_cell(k, r, seed), -F.col("n"), k, _check(k), zero) for r in range(ROWS) if r != row]
    found = line(F.lit(-1).cast("long"), F.col("n"), zero, zero, k)
    same = line(*map(F.col, ("c", "n", "k", "x", "g")))
    moved = cells.select(*by, "w", F.inline(F.when(alone, F.array(*out, found)).otherwise(F.array(same))))
    left = moved.groupBy(*by, "w", "c", "g").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x"))
    return left.where("n <> 0 or k <> 0 or x <> 0").select(*by, "w", "c", "n", "k", "x", "g")


def recover(pairs: DataFrame, buckets: int, made: list[DataFrame] | None = None) -> DataFrame:
    """pairs(range, id, w, a, b) -> (range, id, k, n, tries): the digests only in a (n 1) and only in b (n -1), and sketches it took.

    w is the first number of cells in a row.  Nothing but sketches of a and b is compared.  The written tables that the result
    reads, and nothing else needs, are added to made.
    """
    by, found, seed, todo = ("range", "id"), [], 0, pairs
    made = [] if made is None else made
    while True:
        both = F.array(F.struct(F.lit(1).cast("long").alias("s"), F.col("a").alias("keys")), F.struct(F.lit(-1).cast("long").alias("s"), F.col("b").alias("keys")))
        rows = todo.select(*by, F.shiftleft(F.col("w").cast("long"), seed).alias("w"), F.inline(both)).select(*by, "w", "s", F.explode("keys").alias("key"))
        cells, turn, done = sketch(rows, by, seed).withColumn("g", F.lit(0).cast("long")), 0, []
        turns: list[DataFrame] = []
        while True:
            for _ in range(TURNS):
                cells, turn = peel(cells, by, turn % ROWS, seed), turn + 1
            cells = bucketed(cells, buckets)
            turns.append(cells)
            done.append(cells.where("c < 0").select("range", "id", F.col("g").alias("k"), "n", F.lit(seed + 1).alias("tries")))
            left, got = cells.agg(F.count_if(F.col("c") >= 0), F.count_if(F.col("c") < 0)).first()
            if not left or not got:
                break
            cells = cells.where("c >= 0")  # what is found needs no further turn
        if not left:
            made += turns
            return reduce_union([*found, *done])
        stuck = write_out(cells.where("c >= 0").select("id").distinct(), "iblt-stuck")
        found.append(write_out(reduce_union(done).join(stuck, "id", "left_anti").select("range", "id", "k", "n", "tries"), "iblt-found"))
        made += [stuck, found[-1]]
        drop_written(*turns)
        todo, seed = todo.join(stuck, "id", "left_semi"), seed + 1


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df as a written table dealt by range; aggregates by range need no exchange."""
    table = f"quillon_iblt_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "range").saveAsTable(table)
    return keep_table(df.sparkSession, table)


def width(a: Column, b: Column) -> Column:
    """Cells in a row for the difference of two sorted sets of digests, by their smallest ones."""
    few = F.array_distinct(F.concat(F.slice(a, 1, SAMPLE), F.slice(b, 1, SAMPLE)))
    some = F.slice(F.sort_array(few), 1, SAMPLE)  # smallest digests of both together
    both = F.size(F.array_intersect(F.array_intersect(some, a), b))
    like = F.when(F.size(some) == 0, 1.0).otherwise(both / F.size(some))
    return (F.ceil((F.size(a) + F.size(b)) * (1 - like) / (1 + like) * PER_DIGEST) + MORE_CELLS).cast("long")


def likeness(only_a: Column, a: Column, b: Column) -> Column:
    """Share of common digests among all of both; 1 if neither has any.  only_a: how many were found only in a."""
    return F.when(b + only_a == 0, 1.0).otherwise((a - only_a) / (b + only_a))


def with_next(docs: DataFrame) -> DataFrame:
    """(range, doc_id, text, next): each text (null: empty) with that of the next row by doc_id, then text hash; the last with the first.

    Rows without a doc_id come last.  Rows are dealt to ranges of doc_id by quantiles, an id that many rows share to ranges of
    text hashes; a range also gets the first row of the following one, so texts move once and no task sees more than a range.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("key"), F.xxhash64("text").alias("h"), "doc_id", "text")
    total = d.count()
    ranges = min(MAX_RANGES, max(1, total // RANGE_ROWS))
    quantiles = d.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    times: dict[int, int] = {}
    for q in quantiles or []:
        times[q] = times.get(q, 0) + 1
    bounds = sorted(times)
    column = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  folded into a literal
    wide = column(bounds or [1 << 62])
    halves = F.array(*[F.lit(1 << k) for k in range(max(1, len(bounds)).bit_length() - 1, -1, -1)])
    if bounds:  # how many bounds are not above the key
        at = F.aggregate(halves, F.lit(0), lambda n, step: F.when((n + step <= len(bounds)) & (F.get(wide, n + step - 1) <= F.col("key")), n + step).otherwise(n))
        starts = [1]
        for b in bounds:
            starts.append(starts[-1] + times[b])
        d = d.withColumn("at", at)
        before, many = F.get(column([0, *starts[:-1]]), F.col("at")), F.get(column([1, *[times[b] for b in bounds]]), F.col("at"))
        share = F.floor((F.col("h") / 2.0**64 + 0.5) * many)
        inside = F.when(F.get(wide, F.col("at") - 1) == F.col("key"), F.least(many - 1, share)).otherwise(many - 1)
        d = d.withColumn("range", (before + F.when(F.col("at") > 0, inside).otherwise(0)).cast("int")).drop("at")
    else:
        d = d.withColumn("range", F.lit(0))
    firsts = {r["range"]: r["f"] for r in d.groupBy("range").agg(F.min(F.struct("key", "h")).alias("f")).collect()}  # one row per range
    used = sorted(firsts)
    if not used:
        return spark.createDataFrame([], "range int, doc_id long, text string, next string")
    size = max(used) + 1
    before = {r: used[k - 1] for k, r in enumerate(used)}  # the first range comes after the last
    full = [firsts.get(r) for r in range(size)]
    is_first = (F.get(column([f["key"] if f else 0 for f in full]), F.col("range")) == F.col("key")) & (F.get(column([f["h"] if f else 0 for f in full]), F.col("range")) == F.col("h"))
    guest = F.when(is_first, F.struct(F.get(column([before.get(r, 0) for r in range(size)]), F.col("range")).cast("int").alias("range"), F.lit(True).alias("guest")))
    dealt = d.withColumn("to", F.explode(F.array_compact(F.array(F.struct("range", F.lit(False).alias("guest")), guest)))).select("doc_id", "key", "h", "text", "to.range", "to.guest")
    order = Window.partitionBy("range").orderBy("guest", "key", "h")
    return dealt.withColumn("next", F.lead("text").over(order)).where("not guest").select("range", "doc_id", "text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, the edited text's SHA-256, both fingerprints and likenesses, counts.

    The edited text has its last half (rounded down) replaced by the start of the next document.  A null text is empty; a
    table of one row is its own next.  Equal texts have equal fingerprints; that of a text without a passage is empty.
    n_edited counts the digests recovered against the edited text, tries the sketches that both comparisons took, one each at least.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    d = d.select("range", "doc_id", n.cast("long").alias("n_chars"), "text", "next", edited.alias("edited"))
    d = d.select("range", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[digests(F.col(c)).alias(k) for c, k in (("text", "a"), ("edited", "e"), ("next", "x"))])
    keys = bucketed(d.withColumn("row", F.monotonically_increasing_id()), buckets)
    del d
    let_go(spark)  # the texts' shuffle files
    a, e, x = F.col("a"), F.col("e"), F.col("x")

    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("keys")) for k, c in enumerate((a, e))])
    each = keys.select("range", "row", F.inline(kinds)).select("range", "row", "kind", F.lit(WIDTH).cast("long").alias("w"), F.lit(1).cast("long").alias("s"), F.explode("keys").alias("key"))
    cells = sketch(each, ("range", "row", "kind"), 0)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "n", "k", "x"))), lambda c: F.concat_ws(".", F.hex(c["c"]), F.hex(c["n"]), F.hex(c["k"]), F.hex(c["x"]))), " ")
    blocks = cells.groupBy("range", "row", "kind").agg(shown.alias("block"))
    prints = blocks.groupBy("range", "row").agg(*[F.max(F.when(F.col("kind") == k, F.col("block"))).alias(f"print{k}") for k in range(2)])

    two = F.array(*[F.struct((F.col("row") * 2 + k).alias("id"), width(a, b).alias("w"), a.alias("a"), b.alias("b")) for k, b in enumerate((e, x))])
    made: list[DataFrame] = []
    found = recover(keys.select("range", F.inline(two)), buckets, made)
    counts = found.groupBy("range", "id").agg(F.count_if(F.col("n") == 1).alias("mine"), F.count("*").alias("all"), F.max("tries").alias("tries"))
    by_row = counts.groupBy("range", F.shiftright("id", 1).alias("row")).agg(
        *[F.max(F.when(F.col("id") % 2 == k, F.col(c))).alias(f"{c}{k}") for k in range(2) for c in ("mine", "all")], F.sum(F.col("tries") - 1).alias("more")
    )
    by_row = bucketed(by_row.repartition(buckets, "range"), buckets)  # so that the fingerprints are joined where they are
    drop_written(*made)
    out = keys.select("range", "row", "doc_id", "n_chars", "edited_sha256", *[F.size(k).alias(f"n_{k}") for k in "aex"]).join(prints, ["range", "row"], "left").join(by_row, ["range", "row"], "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        F.coalesce("print0", F.lit("")).alias("fingerprint"), F.coalesce("print1", F.lit("")).alias("edited_fingerprint"),
        likeness(some("mine0"), F.col("n_a"), F.col("n_e")).alias("near_edited"), likeness(some("mine1"), F.col("n_a"), F.col("n_x")).alias("near_next"),
        F.col("n_a").alias("n_passages"), some("all0").alias("n_edited"), (some("more") + 2).alias("tries"),
    )
