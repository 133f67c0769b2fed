from collections import Counter

import numpy as np
import pyarrow as pa

from quillon.llm import lm
from quillon.llm.common import ASCII_LOWER


def test_words_are_those_of_split():
    texts = [" a\x0bb \x1c c\x85d\x00e  ", "", None, "  ", "Ä ä A a\tA\r\n\f a", "é x a"]
    got = lm._word_counts(lm._lower(pa.array(texts, pa.string())))
    want = Counter(w.decode() for t in texts for w in (t or "").encode().translate(ASCII_LOWER).split())
    assert dict(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True)) == want
    assert lm._word_counts(lm._lower(pa.array([None, ""], pa.string()))).num_rows == 0


def test_slots_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(np.frombuffer(b"ab c.\n9\xc3\xa9", np.uint8), int(n))) for n in rng.integers(0, 90, 60)]
    whole = lm._slots(texts)
    monkeypatch.setattr(lm, "CONTEXT_BYTES", 64)
    monkeypatch.setattr(lm, "_HASHED", 7)
    lm._POWERS.clear()
    assert (lm._slots(texts) == whole).all() and len(whole) == sum(map(len, texts)) + len(texts)
    some = lm.hashes(whole >> np.uint64(8))
    monkeypatch.setattr(lm, "_HASHED", 1 << 14)
    assert (lm.hashes(whole >> np.uint64(8)) == some).all()


def test_gate_is_kind_and_depth():
    counts = np.zeros((256, 256))
    counts[97, 98:110] = 2.0 ** np.arange(12)  # other bytes before share the code of all
    code = lm.Code.of(counts)
    for pair in (97 << 8 | 98, 97 << 8 | 109, 32 << 8 | 98, 46 << 8 | 7, 200 << 8 | 255):
        s, n = code.start[pair], code.length[pair]
        assert code.gate[s : s + n].tolist() == [lm._KIND[pair >> 8] * lm._DEPTHS + min(d, lm._DEPTHS - 1) for d in range(n)]
