import random

import pytest
from pyspark.sql import functions as F

from quillon.config import Metric, Space
from quillon.errors import EngineError
from quillon.operators import store, sync
from quillon.sources import ingest
from quillon.streaming import upsert

OPS = "ordinal int, op string, id long, vector array<float>"
SPACE = Space("m", 2, Metric.SQUARED_L2)


def test_fold_and_report_follow_a_model(spark):
    rng = random.Random(42)
    rows, model, want = [], {i: 0.0 for i in range(4)}, {}
    for seq in range(25):
        w = {"inserted": 0, "updated": 0, "deleted": 0, "absent": 0}
        for ordinal in range(rng.randrange(1, 12)):
            i, op = rng.randrange(12), rng.choice(["put", "put", "delete"])
            rows.append((seq, ordinal, op, i, float(len(rows))))
            w["inserted" if op == "put" and i not in model else "updated" if op == "put" else "deleted" if i in model else "absent"] += 1
            if op == "put":
                model[i] = float(len(rows) - 1)
            else:
                model.pop(i, None)
        want[seq] = w
    m = spark.createDataFrame(rows, "seq long, ordinal int, op string, id long, value double")
    base = spark.createDataFrame([(i, 0.0) for i in range(4)], "id long, value double")
    assert {r["id"]: r["value"] for r in store.fold(m, base).collect()} == model
    assert {r["seq"]: {k: r[k] for k in ("inserted", "updated", "deleted", "absent")} for r in store.batch_report(m, base).collect()} == want


def test_store(spark, tmp_path):
    s = store.Store.create(spark, str(tmp_path), "one", SPACE, "id long, vector array<float>")
    with pytest.raises(EngineError) as e:
        store.Store.create(spark, str(tmp_path), "one", SPACE, "id long, vector array<float>")
    assert e.value.kind == "AlreadyExists"
    ops = lambda *rows: spark.createDataFrame(list(rows), OPS)
    r = s.write_batch(ops((0, "put", 1, [1.0, 2.0]), (1, "put", 2, [0.0, 0.0]), (2, "delete", 1, None), (3, "put", 1, [5.0, 5.0])), batch_id="a")
    assert (r["inserted"], r["deleted"], r["sequence"]) == (3, 1, 1)
    assert s.write_batch(ops((0, "put", 9, [1.0, 1.0])), batch_id="a")["inserted"] == 0
    assert s.write_batch(ops((0, "delete", 77, None)))["sequence"] == 1
    with pytest.raises(EngineError) as e:
        s.write_batch(ops((0, "delete", 1, None)), if_sequence=0)
    assert e.value.kind == "Conflict"
    with pytest.raises(EngineError):
        s.write_batch(ops((0, "put", 1, [1.0])))
    assert s.write_batch(ops((0, "delete", 2, None)), if_sequence=1)["deleted"] == 1
    s.checkpoint()
    again = store.Store(spark, f"{tmp_path}/one")
    assert [(r["id"], r["vector"]) for r in again.state().collect()] == [(1, [5.0, 5.0])]
    again.export(f"{tmp_path}/copy")
    with pytest.raises(EngineError):
        again.export(f"{tmp_path}/copy")


def test_stream_applies_each_batch_once(spark, tmp_path):
    s = store.Store.create(spark, str(tmp_path), "s", SPACE, "id long, vector array<float>")
    spark.createDataFrame([(0, "put", 1, [1.0, 1.0]), (1, "put", 2, [2.0, 2.0])], OPS).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = upsert.upsert(spark.readStream.schema(OPS).parquet(f"{tmp_path}/in"), s, f"{tmp_path}/cp")
        q.awaitTermination(120)
    assert s.state().count() == 2 and s.manifest["sequence"] == 1
    bad = upsert.parse_requests(spark.createDataFrame([('{"qid":1,"vector":[1.0],"k":2}',), ("nonsense",)], "value string")).collect()
    assert [r["error"] for r in bad] == [None, "InvalidInput"]


def test_generations(spark, tmp_path):
    df = spark.createDataFrame([(2, [1.0]), (1, [2.0])], "id long, vector array<float>")
    assert store.publish(df, f"{tmp_path}/g", 5) == 1
    pinned = store.open_generation(spark, f"{tmp_path}/g")
    assert store.publish(df.limit(1), f"{tmp_path}/g", 5) == 2
    assert pinned.count() == 2 and store.open_generation(spark, f"{tmp_path}/g").count() == 1
    with pytest.raises(EngineError):
        store.publish(df, f"{tmp_path}/g", 4)
    with pytest.raises(EngineError):
        store.publish(df.union(df), f"{tmp_path}/g", 6)
    with pytest.raises(EngineError):
        store.publish(df.union(spark.createDataFrame([(None, [1.0])], df.schema)), f"{tmp_path}/g", 6)
    assert not (tmp_path / "g" / "gen=3").exists()
    assert store.publish(df, f"{tmp_path}/g", 6) == 3
    name = store.pin(spark, f"{tmp_path}/g", 1)
    assert store.collect_generations(spark, f"{tmp_path}/g") == [2]
    assert [(r["generation"], r["current"], r["pins"]) for r in store.generations(spark, f"{tmp_path}/g").orderBy("generation").collect()] == [(1, False, 1), (3, True, 0)]
    store.unpin(spark, f"{tmp_path}/g", name)
    assert store.collect_generations(spark, f"{tmp_path}/g") == [1] and store.open_generation(spark, f"{tmp_path}/g").count() == 2
    with pytest.raises(EngineError):
        store.open_generation(spark, f"{tmp_path}/g", 1)


def test_maintenance_backup_and_recovery(spark, tmp_path):
    s = store.Store.create(spark, str(tmp_path), "kept", SPACE, "id long, vector array<float>")
    ops = lambda *rows: spark.createDataFrame(list(rows), OPS)
    s.write_batch(ops(*[(i, "put", i, [float(i), 0.0]) for i in range(10)]), batch_id="first")
    assert s.maintain() == "none" and s.maintain(store.Policy(log_bytes=1)) == "checkpoint"
    s.write_batch(ops(*[(i, "delete", i, None) for i in range(6)]), batch_id="second")
    assert s.maintain(store.Policy(dead_rows=5, dead_share=0.5)) == "compact"
    assert sorted(p.name for p in (tmp_path / "kept").glob("v=*")) == ["v=2"] and not list((tmp_path / "kept" / "log").glob("seq=*"))
    assert sorted(r["id"] for r in s.state().collect()) == [6, 7, 8, 9]
    assert s.write_batch(ops((0, "put", 50, [1.0, 1.0])), batch_id="first")["inserted"] == 0
    copy = s.backup(str(tmp_path), "copy")
    copy.write_batch(ops((0, "put", 99, [1.0, 1.0])))
    assert copy.state().count() == 5 and s.state().count() == 4
    with pytest.raises(EngineError):
        copy.import_rows(s.state())
    fresh = store.Store.create(spark, str(tmp_path), "fresh", SPACE, "id long, vector array<float>")
    with pytest.raises(EngineError):
        fresh.import_rows(s.state().union(s.state()))
    assert fresh.import_rows(s.state()) == 4 and fresh.state().count() == 4
    import shutil

    shutil.rmtree(tmp_path / "copy" / "log" / "seq=2")
    with pytest.raises(EngineError) as e:
        store.Store(spark, f"{tmp_path}/copy").state()
    assert e.value.kind == "Corrupt"
    (tmp_path / "kept" / "lock").write_text("{}")
    with pytest.raises(EngineError) as e:
        s.checkpoint()
    assert e.value.kind == "Locked"
    import os

    os.utime(tmp_path / "kept" / "lock", (1, 1))
    assert s.checkpoint() == 0


def test_mutations_without_an_operation_are_refused(spark, tmp_path):
    s = store.Store.create(spark, str(tmp_path), "n", SPACE, "id long, vector array<float>")
    for bad in ((0, None, 7, [1.0, 1.0]), (0, "patch", 7, [1.0, 1.0]), (0, "put", None, [1.0, 1.0]), (0, "put", 7, None), (0, "put", 7, [1.0, None])):
        with pytest.raises(EngineError):
            s.write_batch(spark.createDataFrame([bad], OPS))
    with pytest.raises(Exception, match="put or a delete"):
        store.fold(spark.createDataFrame([(1, 0, None, 7, 2.0)], "seq long, ordinal int, op string, id long, value double")).collect()


def test_a_session_answers(spark, tmp_path):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, vector array<float>")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"qid": 1, "vector": [3.2, 1.0], "k": 2}\n{"qid": 2, "vector": [8, 1], "k": 1}\nnonsense\n')
    upsert.serve(spark.readStream.text(f"{tmp_path}/in"), corpus, Metric.SQUARED_L2, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    rows = spark.read.schema("qid long, id long, distance double, rank int, error string").json(f"{tmp_path}/out/*").collect()
    assert sorted((r["qid"], r["rank"], r["id"]) for r in rows if r["error"] is None) == [(1, 1, 3), (1, 2, 4), (2, 1, 8)] and [r["error"] for r in rows if r["error"]] == ["InvalidInput"]


def test_doctor_and_policy(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [float("nan"), 0.0]), (3, [1.0]), (4, [0.0, 0.0])], "id long, vector array<float>")
    assert store.doctor(df, Space("m", 2, Metric.COSINE)).first().asDict() == {"rows": 4, "repeated_ids": 1, "null_ids": 0, "not_finite": 1, "wrong_dimensions": 1, "zero_vectors": 1}
    assert store.Policy().action(1000, 800, 0) == "compact" and store.Policy().action(1000, 900, 65 << 20) == "checkpoint" and store.Policy().action(10, 10, 0) == "none"


def test_jsonl_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(7, "héllo\nx", "a.md", 1, 2, ["t"], {"n": 1.5}, None, [0.5, 1.0])], ingest.DOCUMENT)
    ingest.write_jsonl(docs, f"{tmp_path}/j", SPACE)
    assert ingest.read_jsonl(spark, f"{tmp_path}/j", SPACE).collect() == docs.collect()
    with pytest.raises(EngineError):
        ingest.read_jsonl(spark, f"{tmp_path}/j", Space("m", 3, Metric.SQUARED_L2))
    (tmp_path / "bad.jsonl").write_text((next((tmp_path / "j").glob("part-*"))).read_text() + "nonsense\n")
    with pytest.raises(EngineError):
        ingest.read_jsonl(spark, f"{tmp_path}/bad.jsonl", SPACE)


def test_tsv_and_fvecs(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("put\t1\t1,2\tmeta\twith tab\ndelete\t2\n")
    rows = ingest.read_tsv(spark, f"{tmp_path}/m.tsv").orderBy("ordinal").collect()
    assert [(r["op"], r["id"], r["vector"], r["metadata"]) for r in rows] == [("put", 1, [1.0, 2.0], "meta\twith tab"), ("delete", 2, None, None)]
    (tmp_path / "bad.tsv").write_text("put\t1\n")
    with pytest.raises(Exception, match="bad mutation"):
        ingest.read_tsv(spark, f"{tmp_path}/bad.tsv").collect()
    import numpy as np

    data = b"".join(np.int32(3).tobytes() + np.array([i, 0.5, -1], "<f4").tobytes() for i in range(5))
    (tmp_path / "v.fvecs").write_bytes(data)
    assert sorted(r["vector"] for r in ingest.read_fvecs(spark, f"{tmp_path}/v.fvecs", 3).collect()) == [[float(i), 0.5, -1.0] for i in range(5)]


def test_chunks(spark, tmp_path):
    long = "한" * 1500  # 4500 bytes
    assert [len(c[2].encode()) for c in ingest.chunk_text(long)] == [3000, 1500]
    md = "# A\ntext\n```\n# not a heading\n```\n## B\nmore\n"
    assert [(a, b) for a, b, _ in ingest.chunk_text(md, "markdown-v1")] == [(1, 5), (6, 7)]
    assert "".join(c[2] for c in ingest.chunk_text(md)) == md and ingest.chunk_text(" \n\n") == []
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "sub" / "x.md").write_text("hello\n")
    (tmp_path / "d" / "y.bin").write_text("no\n")
    row = ingest.read_folder(spark, f"{tmp_path}/d", attributes=True).collect()
    assert [(r["source"], r["text"], r["numbers"]["file_bytes"]) for r in row] == [("sub/x.md", "hello\n", 6.0)]


def test_sync(spark):
    cols = "source string, text string, start_line int, end_line int, tags array<string>"
    old = spark.createDataFrame([("a.md", "one", 1, 1, ["t"]), ("a.md", "two", 2, 2, ["t"]), ("b.md", "b", 1, 1, ["t"]), ("c.md", "c", 1, 1, ["t"]), ("d.txt", "d", 1, 1, ["t"])], cols).withColumn("id", F.monotonically_increasing_id())
    old = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(old.collect())], f"id long, {cols}")
    new = spark.createDataFrame([("a.md", "zero", 1, 1, ["t"], 0), ("a.md", "one", 1, 1, ["t"], 1), ("a.md", "three", 3, 3, ["t"], 2), ("b.md", "b", 1, 1, ["t"], 0)], f"{cols}, chunk int")
    planned = sync.plan(old, new, prune=True)
    got = sorted((r["source"], r["position"], r["action"], r["id"], r["reuse"]) for r in planned.collect() if r["source"] == "a.md" and r["id"] is not None)
    assert got == [("a.md", 1, "update", 0, None), ("a.md", 2, "update", 1, 0)]
    assert sync.report(planned).first().asDict() == {"changed": 2, "unchanged": 2, "puts": 3, "deleted": 1, "reused": 1, "embed": 2}
