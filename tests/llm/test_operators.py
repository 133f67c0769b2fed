import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from quillon.llm import compression, iblt, langid, licenses, linededup, lm, mixing, packing, simhash, warc

SF = "/root/testdata/sf0.001"
LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def one(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect() if r["doc_id"] is not None)


def test_compression_base_by_brute_force(docs, texts):
    got = {r["doc_id"]: r for r in compression.rules(docs).collect()}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = defaultdict(list)
        for i in range(len(w) - 4):
            grams[tuple(w[i : i + 5])].append(i)
        cover = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and (not r["kept"] or not r["base_failed"])


def test_compression_bands():
    z = zstandard.ZstdCompressor(level=3)
    noise = np.random.default_rng(0).integers(0, 256, 5000, np.uint8).tobytes()
    assert compression.verdict(noise, z)[3] == "incompressible" and compression.verdict(b"spam " * 1000, z)[3] == "repetitive"
    words = " ".join(hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 6] for i in range(900)).encode()
    prose = words.translate(bytes(97 + b % 26 for b in range(256)))
    assert compression.verdict(prose, z)[3] is None
    assert compression.verdict(prose[:4096] + b"ha " * 1400, z)[3] is not None


def test_repeated_words_exact_for_many_words():
    words = [f"w{i}".encode() for i in range(9000)]
    assert compression.repeated(words) == 0 and compression.repeated(words + words[:5]) == 10 and compression.repeated([b"a"] * 6) == 6


def test_simhash_by_brute_force(docs, texts):
    import xxhash

    def fp(t):
        w = t.encode().translate(LOW).split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    mine = {d: fp(t) for d, t in texts.items()}
    ids = sorted(mine)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (mine[a] ^ mine[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [(d, mine[d] - (1 << 64) if mine[d] >> 63 else mine[d], find(d)) for d in ids]
    assert one(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    assert one(simhash.near_duplicates(docs, dense_cell=0), "doc_id", "fp", "component_id") == want  # all through balls
    assert one(simhash.near_duplicates(docs, dense_cell=0, dense_fine=1 << 40), "doc_id", "fp", "component_id") == want  # all through the finer grid
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == {find(d) for d in ids}


def test_near_dedup_keeps_rows_that_share_an_id(spark):
    rows = [(5, "one text about rivers and their long banks", "b"), (5, "quite another text on steel and iron ore", "a"), (5, "one text about rivers and their long banks", "a"), (None, "no id in this row but words", "a"), (7, "no id in this row but words", "a"), (None, "a last row without id", None)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string"))
    assert out.columns == ["doc_id", "text", "a.b"]
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, out.collect()), key=key) == sorted([rows[1], rows[2], rows[4], rows[5]], key=key)


def test_thermometer_bounds_hamming(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 62), 1 << 62, 300)
    b = a ^ (1 << rng.integers(0, 62, 300)) ^ (1 << rng.integers(0, 62, 300))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    low = F.bit_count(simhash.thermometer(F.col("a")).bitwiseXOR(simhash.thermometer(F.col("b"))))
    assert df.where(low > F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).count() == 0


def test_language_id_held_out(spark, docs):
    model = langid.train(docs)
    assert model.languages == sorted(r["lang"] for r in docs.where("lang is not null").select("lang").distinct().collect())
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    held = [(r["lang"], pred[r["doc_id"]]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (3, "")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(odd, model).collect()] == ["und"] * 3
    assert langid.accepted(odd, model).count() == 0 and langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0


def ppm_bits(train, text):
    """Bits of each byte of text, by the recursion over contexts, from the texts in train."""
    seen = defaultdict(Counter)
    for t in train:
        t = langid._PAD + t
        for i in range(langid.ORDER, len(t)):
            for k in range(langid.ORDER + 1):
                seen[t[i - k : i]][t[i]] += 1

    def p(context, byte):
        lower = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        here = seen.get(context)
        if not here:
            return lower(byte)
        n, d = sum(here.values()), len(here)
        if byte in here:
            return here[byte] / (n + d)
        return d / (n + d) * lower(byte) / (1 - sum(map(lower, here)))

    t = langid._PAD + text
    return [-math.log2(p(t[i - langid.ORDER : i], t[i])) for i in range(langid.ORDER, len(t))]


def grams_of(train):
    out = [np.unique(np.concatenate([langid._grams(langid._PAD + t) for t in ts]), return_counts=True) for ts in train]
    return np.repeat(np.arange(len(out)), [len(g) for g, _ in out]), np.concatenate([g for g, _ in out]), np.concatenate([n for _, n in out]).astype(float)


def test_language_id_lengths_by_recursion(docs):
    train = [[langid.normalised(r["text"][:200].encode()) for r in docs.where(f"lang = '{name}'").limit(4).collect()] for name in ("en", "fr", "de")]
    model = langid.Model(["en", "fr", "de"], [langid.fit(3, *grams_of(train))])
    texts = [train[0][0][:60], train[1][1][50:90] + train[2][0][:30], b"", bytes(range(200, 256)) + b"zq\0x"]
    got = model.lengths(texts)
    for i, t in enumerate(texts):
        assert np.allclose(got[i], [sum(ppm_bits(ts, t)) for ts in train], rtol=1e-4, atol=1e-3)
    every = np.array([int.from_bytes(texts[0][:4] + bytes([b]), "big") for b in range(256)])
    assert np.allclose((2.0 ** -model.groups[0].lengths(every).astype(float)).sum(0), 1, atol=1e-3)


def test_language_id_takes_many_languages(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(70):  # each language has its own words
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(30)]
        rows += [(100 * k + i, f"l{k:02}", " ".join(rng.choice(words, 40))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs)
    assert len(model.languages) == 70 and len(model.groups) == 9
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert all(pred[d] == name for d, name, _ in rows)


def lines_removed(texts, t=0.8):
    sets, out = [], set()
    for d in sorted(texts):
        for n, line in enumerate((texts[d] or "").split("\n")):
            if s := set(line.lower().split()):
                if any(min(len(s), len(o)) >= t * max(len(s), len(o)) and len(s & o) / len(s | o) >= t for o in sets):
                    out.add((d, n))
                sets.append(s)
    return out


def test_line_dedup_by_brute_force(spark, docs, texts):
    got = {(r["doc_id"], n) for r in linededup.dedup(docs).collect() for n in r["removed"]}
    assert got == lines_removed(texts)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(12)]
    made = {}
    for d in range(60):  # one group of variants, larger than a window's reach
        w = list(base)
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, 12)] = f"v{rng.integers(0, 40)}"
        made[d] = " ".join(w) + "\nshort line\n" + " ".join(w[:6])
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    out = linededup.dedup(df).collect()
    gone = {(r["doc_id"], n) for r in out for n in r["removed"]}
    assert gone == lines_removed(made)
    # words have leaders, and are hot: leaders, then pairs of words
    assert {(r["doc_id"], r["n"]) for r in linededup.removals(df, led_rows=3, hot_rows=8, bits=4).collect()} == gone
    for r in out:
        assert r["text"] == "\n".join(x for n, x in enumerate(made[r["doc_id"]].split("\n")) if (r["doc_id"], n) not in gone)


def test_line_dedup_takes_short_lines(spark):
    rows = {
        1: "All rights reserved.\na b c d\n\none", 2: "all  rights   reserved.\na b c d e\n\ntwo", 3: "reserved. rights All\nb c d e f g\n \none", 4: "x   y   z\na b c\nONE one",
        5: "x y z\na b c d x\nseven words of a line that stays",
    }
    sets, want = [], set()
    for d, text in rows.items():
        for n, line in enumerate(text.split("\n")):
            if x := set(line.lower().split()):
                if any(len(x & o) / len(x | o) >= 0.8 for o in sets):
                    want.add((d, n))
                sets.append(x)
    out = linededup.dedup(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    got = [(r["doc_id"], n) for r in out for n in r["removed"]]
    assert sorted(got) == sorted(want) and {(2, 0), (2, 1), (3, 0), (3, 3), (4, 2), (5, 0), (5, 1)} == want


def test_line_dedup_makes_few_pairs_of_nearly_similar_lines(spark, monkeypatch):
    """Lines that share most words, but not enough: what is compared word by word doesn't grow with their square."""
    rng = np.random.default_rng(5)
    made = {}
    for d in range(300):
        w = [f"w{i}" for i in range(40)]
        for i in rng.choice(40, 3, replace=False):
            w[i] = f"v{rng.integers(0, 2000)}"
        made[d] = " ".join(w)
    compared, verified = [], linededup._verified
    monkeypatch.setattr(linededup, "_verified", lambda pairs, *more: (compared.append(pairs.distinct().count()), verified(pairs, *more))[1])
    monkeypatch.setattr(linededup, "TURN_ROWS", 500, raising=False)  # words go in several turns, too
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {(r["doc_id"], r["n"]) for r in linededup.removals(df).collect()} == lines_removed(made)
    assert sum(compared) < 10 * len(made)


def test_iblt_by_brute_force(docs, texts):
    passages = lambda t: {p for p in re.split(r"\n|(?<=[.!?]) +", t) if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in iblt.fingerprints(docs).collect()}
    prints = {}
    for k, d in enumerate(ids):
        t, x = texts[d], texts[ids[(k + 1) % len(ids)]]
        e = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r["near_edited"] - like(passages(t), passages(e))) < 1e-12 and abs(r["near_next"] - like(passages(t), passages(x))) < 1e-12
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_iblt_recovers_what_differs(spark):
    """Sketches alone against sets: small differences, none, all, and tables far too small at first."""
    rng = np.random.default_rng(12)
    sets = {}
    for i in range(40):
        common, a, b = (set(rng.integers(-(1 << 62), 1 << 62, n).tolist()) for n in (rng.integers(0, 60), rng.integers(0, 1 + 3 * i), rng.integers(0, 30)))
        sets[i] = (common | a, common | b)
    sets[40], sets[41], sets[42] = (set(), set()), ({5, 6}, {5, 6}), (set(range(1000)), set())
    for w in (2, 200):
        rows = [(i % 3, i, w, sorted(a), sorted(b)) for i, (a, b) in sets.items()]
        got = defaultdict(set)
        tries = Counter()
        for r in iblt.recover(spark.createDataFrame(rows, "range int, id long, w long, a array<long>, b array<long>"), 4).collect():
            assert (r["k"], r["n"]) not in got[r["id"]]
            got[r["id"]].add((r["k"], r["n"]))
            tries[r["id"]] = r["tries"]
        for i, (a, b) in sets.items():
            assert got[i] == {(k, 1) for k in a - b} | {(k, -1) for k in b - a}
        assert tries[42] > 1


def test_iblt_moves_fingerprints_once(spark, docs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = iblt.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    last, joined = [m.start() for m in re.finditer("SortMergeJoin", plan)][:2]
    assert "Exchange" not in plan[last:joined]  # what the first join made stays where it is


def test_iblt_deals_shared_ids_to_ranges(spark):
    rows = [(7 if i % 3 else i, f"text {i}. And {i * i}") for i in range(1500)] + [(None, f"no id {i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = iblt.with_next(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, rows))
    assert max(Counter(r["range"] for r in got).values()) < 1000  # two ids hold most rows
    follows = {(r["doc_id"], r["text"]): r["next"] for r in got}
    assert sorted(follows.values()) == sorted(t for _, t in rows)
    ids = {t: d for d, t in rows}
    none = 1 << 62
    breaks = sum((none if ids[n] is None else ids[n]) < (none if d is None else d) for (d, _), n in follows.items())
    assert breaks == 1  # after the last comes the first


def test_warc_round_trip_and_order(spark):
    pages = spark.createDataFrame([(5, "http://b.org/x?q=1#f", "<p>é"), (2, "https://www.A.com/y", "<p>é"), (3, None, None), (4, "http://a.com/", ""), (9, "http://a.com/", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nWARC-Archive: 0\r\n"), (9, "http://a.com/", "x\r\n\r\n")], "page_id long, url string, html string")
    rows = warc.captures(pages).collect()
    assert [r["urlkey"] for r in rows] == sorted(r["urlkey"] for r in rows)
    by = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in rows}
    assert by == {(5, 5): ("revisit", 2), (2, 5): ("response", None), (3, 0): ("response", None), (4, 0): ("revisit", 3), (9, 41): ("response", None), (9, 5): ("response", None)}
    import base64

    assert {r["payload_digest"] for r in rows if r["page_id"] == 5} == {base64.b32encode(hashlib.sha1("<p>é".encode()).digest()).decode()}


def test_records_of_any_archive(spark, tmp_path):
    import gzip

    record = lambda kind, block, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x.org/\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    blocks = [b"software: x\r\n", b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n\r\n\xff\x00", b"", "é\r\n\r\nWARC/1.1".encode()]
    kinds = ["warcinfo", "response", "metadata", "resource"]
    folded = "WARC-Record-ID: <urn:x>\r\nX-Long: a\r\n  b\r\n"
    made = [record(k, b, folded if k == "response" else "") for k, b in zip(kinds, blocks, strict=True)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "w" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    got = warc.records(spark, str(tmp_path / "w")).orderBy("file", "place").collect()
    assert [(r["type"], bytes(r["block"])) for r in got] == [*zip(kinds, blocks, strict=True)] * 2 and {r["id"] for r in got if r["type"] == "response"} == {"<urn:x>"}
    for broken in (made[1][:-9], b"GET / HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_archives_are_read_back_by_their_lengths(spark, tmp_path):
    pages = spark.createDataFrame([(5, "http://b.org/", "<p>é"), (2, "http://a.com/", "<p>é"), (3, None, None)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "own"))
    got = {(r["type"], bytes(r["block"]).partition(b"\r\n\r\n")[2].decode()) for r in warc.records(spark, str(tmp_path / "own")).collect()}
    assert got == {("response", "<p>é"), ("revisit", ""), ("response", "")}


def test_loser_tree():
    rng = np.random.default_rng(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_lm(docs, texts):
    words = {d: [*t.encode().translate(LOW).split(), b" "] for d, t in texts.items()}
    c = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for hot in (lm.HOT_WORDS, 50):
        rows = lm.score(docs, hot).collect()
        for r in rows:
            ws = words[r["doc_id"]]
            assert r["train_tokens"] == n and r["n_tokens"] == len(ws) and r["n_known"] == sum(w in c for w in ws)
            assert abs(r["base_score"] - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6
            assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    assert sum(r["bits_per_byte"] for r in rows) / len(rows) < 4


def test_licenses(spark):
    d = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny"), (2, "Licensed under CC BY-NC 4.0"), (3, "released under the license of nobody"), (4, None)], "doc_id long, text string")
    got = one(licenses.scan(d), "doc_id", "line", "license", "dice")
    assert got == [(1, -1, "MIT", 0.8), (1, 1, "MIT", 1.0), (2, 0, "CC-BY-NC-4.0", 1.0)]
    for _, t in licenses.TEMPLATES:  # whatever third of its bigrams is missing, an anchor is left
        b = licenses.template_bigrams(t)
        a = set(licenses.anchors([licenses.template_bigrams(x) for _, x in licenses.TEMPLATES]))
        assert sum(not set(x.split()) & a for x in b) < 0.8 / 1.2 * len(b)


def test_licenses_in_windows(spark):
    full = dict(licenses.full_texts())
    gpl = next(t for name, t in licenses.TEMPLATES if name == "GPL-3.0" and len(t) > 100).split()
    wrapped = "\n".join("// " + " ".join(gpl[i : i + 12]) for i in range(0, len(gpl), 12))
    pad = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, f"MIT License\n\nCopyright (c) 2020 Some One\n\n{full['MIT']}"),
        (2, f"{wrapped}\nint main() {{\n  return 0; }}"),
        (3, f"{pad}. Released under the MIT License. {pad}"),
        (4, f"{pad}\n{full['BSD-3-Clause']}\n{pad}\n{full['ISC']}"),
        (5, f"{pad}\nreleased under the\nmit licensing {pad}"),
        (None, f"{pad} Released under the\nMIT License {pad}"),
    ]
    rows += [(10 + k, f"{pad}\n{t}\n{pad}") for k, t in enumerate(full.values())]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = {(r["doc_id"], r["license"]) for r in got}
    want = {(1, "MIT"), (2, "GPL-3.0"), (3, "MIT"), (4, "BSD-3-Clause"), (4, "ISC"), (None, "MIT")}
    assert names == want | {(10 + k, name) for k, name in enumerate(full)} | {(16, "Unlicense")}
    assert [(r["line"], r["dice"]) for r in got if r["doc_id"] == 3] == [(-2, 1.0)]


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs).collect()
    bins = defaultdict(list)
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    assert sorted((r["doc_id"], r["piece"]) for r in rows) == sorted((d, k) for d, x in ids.items() for k in range(math.ceil(len(x) / 2048)))
    for r in rows:
        mine = ids[r["doc_id"]][2048 * r["piece"] : 2048 * (r["piece"] + 1)]
        assert (zlib.crc32(np.array(mine, "<u4").tobytes()), len(mine), 2048 * r["piece"]) == (r["ids_crc32"], r["length"], r["start"])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1


def test_encoder_on_odd_texts():
    enc, tok = packing.Encoder(packing.tokenizer_path(), cached=3), packing.Encoder(packing.tokenizer_path()).whole
    for t in ("", " a\x85b\x1cc ", "It's <|endoftext|> Foo ĞİΣΑΣ é x́ 1²3½ 'll 'RE", "日本語 ß ẞ K", "Straße STRASSE ça va"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    counts = {2048: 3, 2000: 5, 48: 7, 1024: 1, 700: 4, 1: 2}
    rows = packing.plan(counts)
    for length, n in counts.items():
        spans = sorted((a, b) for k, a, b, *_ in rows if k == length)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert packing.fullest({3: 5, 5: 2}, 11) == {5: 1, 3: 2} and packing.fullest({}, 9) == {}


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda rs: sorted((r["doc_id"], r["taken"]) for r in rs)
    assert key(rows) == key(again)
    size, target, taken, most = Counter(), {}, Counter(), Counter()
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    names = sorted(size)
    weight, left = {s: 1 + k % 3 for k, s in enumerate(names)}, set(names)
    total, want = sum(size.values()), {}
    while True:
        room = total - sum(want.values())
        share = {s: room * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * size[s]
            left.discard(s)
    want |= share
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= most[s]
    copies = sum(r["copies"] for r in rows)
    assert mixing.mixed_documents(docs).count() == copies


def test_mixing_takes_maps_repeated_ids_and_clashing_names(spark):
    rows = [(k % 3, f"text {k // 2} of " + "many words " * (1 + k // 2), None if k % 4 == 0 else "s" + str(k % 4), {"x": k // 2}, "n") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>, `key.n` string")
    got = Counter((r["doc_id"], r["text"], r["source"], r["extra"]["x"]) for r in mixing.mixed_documents(docs).collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    sums = Counter()
    for (d, t, s, x), n in got.items():
        assert x == int(t.split()[1])
        sums[d, s, len(t.split())] += n
    assert sums == +want and mixing.mixed_documents(docs).columns == docs.columns
