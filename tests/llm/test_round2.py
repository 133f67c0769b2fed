"""Plans and tables of the corpus operators that grew with the input or held on to too much."""

from pyspark.sql import functions as F

from quillon.llm import common, iblt, linededup, packing


def written(monkeypatch, module, look):
    """Has look(df, name) called for each table that module writes; returns the list of (name, what it gave)."""
    seen, write = [], module.write_out

    def spy(df, name):
        seen.append((name, look(df)))
        return write(df, name)

    monkeypatch.setattr(module, "write_out", spy)
    return seen


def test_line_counts_are_in_one_plan_and_rows_are_shuffled_once(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the same few words but"), F.col("id") % 8, F.col("id") % 5, F.col("id")).alias("text"))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString() + df._jdf.queryExecution().executedPlan().toString()
    seen = written(monkeypatch, linededup, plan)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # plans are whole from the start
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["doc_id"] for r in linededup.removals(docs, bits=8, led_rows=2, hot_rows=4).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    sets = [set(f"the same few words but {i % 8} {i % 5} {i}".split()) for i in range(40)]
    assert got == {y for y in range(40) if any(len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) for x in range(y))}
    assert [name for name, text in seen if "as array<tinyint>" in text] == ["line-heads"]
    met = [text for name, text in seen if name == "line-pairs" and "second" in text]
    assert len(met) == 1 and "ReusedExchange" in met[0]
    assert any(name == "line-pairs" and "posexplode" in text and "second" not in text and "ReusedExchange" in text for name, text in seen)


def test_sketches_go_before_fingerprints_are_joined(spark):
    text = F.concat_ws("\n", *[F.concat(F.lit(f"line {k} of "), F.col("id") * F.col("id") + k * (F.col("id") % 3)) for k in range(12)])
    docs = spark.range(30).select(F.col("id").alias("doc_id"), text.alias("text"))
    tables, written = set(common._tables), set(common._written)
    got = iblt.fingerprints(docs)
    assert len(set(common._tables) - tables) == 2  # the digests and what was recovered, by row
    assert not [path for _, path in set(common._written) - written if "/iblt-" in path]
    assert got.count() == 30 and got.where("near_next = 0 or near_edited < 1").count()


def test_a_worker_keeps_no_words_of_packing_for_other_work(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text")).coalesce(1)

    def held(cols):
        import gc

        return {"n": [sum(type(x).__name__ == "Encoder" for x in gc.get_objects())] * len(cols["doc_id"])}

    assert packing.pieces(docs).count() == 20
    one = packing.pieces(docs).agg(F.sum("length")).first()[0]
    assert {r["n"] for r in common.map_rows(docs, held, "n long").collect()} == {0}
    assert packing.pieces(docs).agg(F.sum("length")).first()[0] == one


def test_line_words_are_lowered_once_and_signed_by_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "One  two\tTHREE\r\nfour\x0bFive Ärger\fΣΑΣ\tx"), (2, None), (3, "")], "doc_id long, text string")
    seen = written(monkeypatch, linededup, lambda df: df._jdf.queryExecution().optimizedPlan().toString())
    t = linededup.sets(docs, spark.createDataFrame([], "doc_id long, h long, n int"))
    assert [text.count("lower(") for name, text in seen if name == "line-sets"] == [1]
    hashed = lambda words: sorted(r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect())
    got = {(r["doc_id"], r["n"]): r["t"] for r in t.collect()}
    assert got == {(1, 0): hashed(["one", "two", "three"]), (1, 1): hashed(["four", "five", "ärger", "σας", "x"]), (3, 0): []}

    sets = [[-(1 << 63), -(1 << 62) - 1, -(1 << 62), -1], [0, 1, 64, 1 << 62, (1 << 63) - 1], [5], [-(1 << 62), 0, 1 << 62]]
    rows = spark.createDataFrame([(k, 0, 0, x) for k, x in enumerate(sets)], "doc_id long, h long, n int, t array<long>")
    heads = linededup.heads(rows, F.array_repeat(F.lit(0).cast("tinyint"), 16), bits=4)
    assert " filter(" not in heads._jdf.queryExecution().optimizedPlan().toString()  # no look at each hash for each part
    for r in heads.collect():
        signs = [0] * 4
        for h in sets[r["doc"]]:
            signs[(h + (1 << 63)) >> 62] ^= 1 << (h & 63)
        assert [r[f"s{k}"] & (1 << 64) - 1 for k in range(4)] == signs
