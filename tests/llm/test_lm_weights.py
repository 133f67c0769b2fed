import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import lm


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    texts = {d: " ".join(f"word{k}" if k % 3 else f"{k}, {k}." for k in rng.integers(0, 50, 40)) for d in range(60)}
    return texts | {60: "ab cd " * 300 + "# the end ! " * 40, 61: "", 62: "é x\n\ny"}


@pytest.fixture(scope="module")
def mixer(spark, corpus):
    docs = spark.createDataFrame([*corpus.items(), (63, None)], "doc_id long, text string")
    least, lm.LEAST_BITS = lm.LEAST_BITS, 21  # no two contexts share a cell
    try:
        return lm.train(docs)[0]
    finally:
        lm.LEAST_BITS = least


def plain_contexts(t, i):
    """What each predictor knows before byte i of padded t; the word so far, or the byte before where there is none."""
    word = i
    while word > lm._FAR and lm._KIND[t[word - 1]] == 1:
        word -= 1
    return [(k, t[i - k : i]) for k in range(1, 5)] + [("word", t[word:i] or t[i - 1 : i], word == i)]


def plain_tables(texts, code):
    seen = defaultdict(lambda: [0, 0])
    for text in texts:
        t = lm._PAD + text + b"\0"
        for i in range(lm._FAR, len(t)):
            pair = t[i - 1] << 8 | t[i]
            for s in range(code.start[pair], code.start[pair] + code.length[pair]):
                for c in plain_contexts(t, i):
                    seen[c, code.node[s]][int(code.bit[s])] += 1
    return seen


def plain_bits(text, code, seen, first):
    """The mixing, one bit after the other."""
    t, w, grad, total = lm._PAD + text + b"\0", first.astype(np.float64).copy(), np.zeros(first.shape), 0.0
    for i in range(lm._FAR, len(t)):
        pair = t[i - 1] << 8 | t[i]
        for depth, s in enumerate(range(code.start[pair], code.start[pair] + code.length[pair])):
            st = []
            for c in plain_contexts(t, i):
                zero, one = seen.get((c, code.node[s]), (0, 0))
                st.append(np.clip(round(math.log((one + lm.SMOOTH) / (zero + lm.SMOOTH)) / lm.UNIT), -127, 127) * lm.UNIT)
            gate = lm._KIND[t[i - 1]] * lm._DEPTHS + min(depth, lm._DEPTHS - 1)
            p = 1 / (1 + math.exp(-float(w[gate] @ st)))
            y = code.bit[s]
            total -= math.log2(p if y else 1 - p)
            grad[gate] += (y - p) * np.array(st)
        if (i - lm._FAR + 1) % lm.BLOCK == 0:
            w, grad = np.clip(w + lm.RATE / 16 * grad, -4, 4), np.zeros(first.shape)
    return total


def test_mixing_by_brute_force(corpus, mixer):
    texts = [x.encode().translate(lm.ASCII_LOWER) for x in corpus.values()]
    seen = plain_tables([*texts, b""], mixer.code)
    some = [texts[0], texts[60], b"", b"word7 ab cd 7, 7. the end ! word12", texts[62]]
    want = [plain_bits(t, mixer.code, seen, mixer.weights) for t in some]
    assert np.allclose(mixer.bits(some), want, rtol=1e-4, atol=1e-2)
    assert np.allclose([mixer.bits([t])[0] for t in some], want, rtol=1e-4, atol=1e-2)  # they don't hang on company


def test_codes_are_whole(mixer):
    for before in (0, 32, 97):
        assert abs(sum(2.0 ** -mixer.code.length[before * 256 : before * 256 + 256]) - 1) < 1e-9


def test_first_weights_serve_all_training_texts(spark, corpus, mixer):
    texts = [x.encode() for x in corpus.values()]
    even = lm.Mixer(mixer.code, mixer.tables, np.full(mixer.weights.shape, lm.FIRST, np.float32))
    assert mixer.bits(texts).sum() < even.bits(texts).sum()
    docs = spark.createDataFrame([*corpus.items()], "doc_id long, text string")
    slots = lm.gather(docs).where("slot is not null").groupBy("slot").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    assert np.allclose(lm.fitted(slots.repartition(1), even), lm.fitted(slots.repartition(5), even), atol=1e-6)


def test_slots_count_every_byte(spark, corpus):
    docs = spark.createDataFrame([*corpus.items(), (99, None)], "doc_id long, text string").repartition(3)
    got = Counter()
    for r in lm.gather(docs).where("slot is not null").collect():
        got[r["slot"] >> 8 & 0xFFFFFFFF, r["slot"] & 255] += r["n"]
    want = Counter()
    for x in [*corpus.values(), ""]:
        t = lm._PAD + x.encode().translate(lm.ASCII_LOWER) + b"\0"
        want.update((int.from_bytes(t[i - 4 : i], "big"), t[i]) for i in range(4, len(t)))
    assert got == want


def test_tables_grow_with_contexts(spark):
    import hashlib

    few, many = (spark.createDataFrame([(d, " ".join(hashlib.md5(f"{d} {i}".encode()).hexdigest() for i in range(k))) for d in range(40)], "doc_id long, text string") for k in (1, 120))
    small, large = (lm.train(x)[0].tables for x in (few, many))
    assert len(large[3]) >= 4 * len(small[3]) and len(large[4]) >= 4 * len(small[4])


def test_word_so_far(corpus):
    text = "many words. any words, manyx antidisestablishment disestablishment"
    buf = np.frombuffer(lm._PAD + text.encode() + b"\0", np.uint8)
    word = lm.hashes(lm.contexts(buf))[4]
    so_far = [re.search(r"[a-z]*$", text[:i])[0] or buf[i + 3] for i in range(len(text) + 1)]
    for i, x in enumerate(so_far):
        assert [word[i] == c for c in word] == [x == y for y in so_far]
