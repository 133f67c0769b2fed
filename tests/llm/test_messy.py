"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables, and extra columns whose names clash."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from quillon.llm import compression, iblt, langid, licenses, linededup, lm, mixing, packing, simhash, warc

LONG = "\n".join(f"line {i} has w{i % 97} x{i % 89} y{i} z{i * 7}" for i in range(3000))
SAME = "same words here twice over"
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", None, 3), (4, LONG, "en", "b", None), (5, SAME, "fr", "b", 1),
    (5, SAME, "fr", "b", 1), (6, SAME, None, "c", 1), (None, "no id at all in this row", "en", "a", 9), (7, "日本語 ÀÉ <|endoftext|> 'll 12", "de", "é", 5),
    (8, "one", "de", "", 1), (9, "12 34 !!", "de", "c", 1), (5, "another text of a shared id", "fr", "b", 2),
]
CLASH = ("key", "key2", "fp", "n", "h", "gone", "row", "line", "page_id", "removed", "n_lines", "matches", "component_id", "a.b", "copy")
LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@pytest.fixture(scope="module")
def messy(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH) + ", extra map<string,int>"
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH), {"k": 1}) for r in ROWS], cols)


def by_text(df, *names):
    return sorted(((r["doc_id"] is None, r["doc_id"], *(r[n] for n in names)) for r in df.collect()), key=str)


def want(f):
    return sorted(((d is None, d, *f(d, t or "")) for d, t, *_ in ROWS), key=str)


def test_compression(messy):
    got = by_text(compression.rules(messy), "n_words", "base_failed")
    assert got == want(lambda d, t: (len(t.split()), len(t.split()) < 10))
    assert compression.rules(messy.limit(0)).collect() == []


def test_simhash(messy):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(messy).collect())
    assert got[1, 1] == got[2, 1] == got[3, 1] == got[6, 5] == got[8, 8] == 1 and got[5, 5] == 3 and sum(got.values()) == len(ROWS)
    assert got[None, None] == 1
    assert simhash.near_duplicates(messy.limit(0)).collect() == []
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(d, t): 1 for d, t, *_ in ROWS if d not in (2, 3, 6)})


def test_language_id(messy):
    model = langid.train(messy)
    got = {(r["doc_id"], r["bits_per_byte"] is None): r["lang_pred"] for r in langid.predict(messy, model).collect()}
    assert {d for (d, none), p in got.items() if none and p == "und"} == {1, 2, 3, 9}
    assert all(p in ("en", "fr", "de") for (_, none), p in got.items() if not none)
    assert langid.train(messy.limit(0)) is None and langid.predict(messy.limit(0), model).collect() == []
    kept = langid.accepted(messy, model)
    assert kept.columns == messy.columns and not {1, 2, 3, 9} & {r["doc_id"] for r in kept.collect()}


def test_line_dedup(messy):
    got = by_text(linededup.dedup(messy), "text", "n_lines", "removed")
    assert got == sorted(((d is None, d, ("" if d == 6 else t), 0 if t is None else len(t.split("\n")), [0] if d == 6 else []) for d, t, *_ in ROWS), key=str)
    assert linededup.dedup(messy.limit(0)).collect() == []
    kept = linededup.without_repeats(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((d, t) for d, t, *_ in ROWS if d != 6)
    assert {r["removed"] for r in rows} == {"clash"} and {r["a.b"] for r in rows} == {"clash"}


def test_line_dedup_keeps_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "totally other line with words here"), (5, "first\na b c d e f")]
    got = Counter((r["doc_id"], r["text"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, "a b c d e f"), (5, ""), (5, "totally other line with words here"), (5, "first")])


def test_iblt(messy):
    rows = iblt.fingerprints(messy).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in rows) == sorted((str(d), len(t or "")) for d, t, *_ in ROWS)
    assert all(0 <= r[k] <= 1 for r in rows for k in ("near_edited", "near_next"))
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)} == {""} and len({r["fingerprint"] for r in rows if r["n_chars"] == len(SAME)}) == 1
    nine = next(r for r in rows if r["doc_id"] == 9)  # the next one is the row without an id
    assert nine["edited_sha256"] == hashlib.sha256(b"12 3no i").hexdigest()
    assert iblt.fingerprints(messy.limit(0)).collect() == []


def test_lm(messy):
    got = by_text(lm.score(messy), "n_tokens", "held_out")
    assert got == want(lambda d, t: (len(t.encode().translate(LOW).split()) + 1, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0))
    rows = lm.score(messy).collect()
    assert all(r["score"] < 0 and r["base_score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert lm.score(messy.limit(0)).collect() == []
    alone = messy.where("doc_id in (1, 2)").union(messy.where("text = 'one'"))
    assert all(math.isfinite(r["score"]) for r in lm.score(alone).collect())


def test_packing(messy):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    lengths = Counter()
    for r in packing.pack(messy).collect():
        lengths[r["doc_id"]] += r["length"]
    ids = Counter()
    for d, t, *_ in ROWS:
        ids[d] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert lengths == ids and packing.pack(messy.limit(0)).collect() == []


def test_mixing(messy):
    rows = mixing.mix(messy).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d), len((t or "").split())) for d, t, *_ in ROWS)
    size = Counter()
    for _, t, _, s, _ in ROWS:
        size[s] += len((t or "").split())
    assert all(r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in rows)
    assert mixing.mix(messy.limit(0)).collect() == [] and mixing.mixed_documents(messy.limit(0)).collect() == []
    mixed = mixing.mixed_documents(messy)
    assert mixed.columns == messy.columns
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == +sum((Counter({(r["doc_id"], next(t for d, t, _, s, _ in ROWS if d == r["doc_id"] and s == r["source"] and len((t or "").split()) == r["size"])): r["copies"]}) for r in rows), Counter())


def test_warc(messy):
    pages = messy.selectExpr("doc_id as page_id", "source as url", "text as html", "key as digest", "fp as first")
    rows = warc.captures(pages).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r["page_id"]), r["payload_digest"]) for r in rows) == sorted((str(d), sha(t)) for d, t, *_ in ROWS)
    assert {(r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit"} == {(2, 1), (6, 5)}
    assert warc.captures(pages.limit(0)).collect() == []


def test_licenses(messy):
    assert licenses.scan(messy).collect() == [] and licenses.scan(messy.limit(0)).collect() == []


def test_pipeline_stages(spark, messy):
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == messy.columns, name
        assert docs.select(*[f"`{c}`" for c in CLASH]).distinct().collect() == [("clash",) * len(CLASH)], name
    assert {r["piece"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} >= {0}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy.limit(0), "").collect() == [], name
