"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks against limits by length."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, map_rows

LEVEL, CHUNK = 3, 2048
SYMBOLS = "#*$%&|<>"
#: (bytes below which it holds, least ratio, largest ratio) of bytes to compressed bytes; shorter texts compress less.
BANDS = ((64, 0.0, float("inf")), (128, 0.75, 2.0), (256, 0.9, 2.3), (512, 1.05, 2.6), (1024, 1.15, 2.9), (2048, 1.25, 3.2), (4096, 1.35, 3.5), (16384, 1.4, 4.0), (1 << 62, 1.45, 5.0))
#: Share of a document's chunks that may be out of their bands.
BAD_CHUNKS = 0.25
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20


def band(n_bytes: int, bands: tuple = BANDS) -> tuple[float, float]:
    return next((low, high) for below, low, high in bands if n_bytes < below)


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included; exact, by ranks of ever longer runs."""
    if len(words) <= window:
        return 0
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    if len(ids) ** window < 1 << 62:
        run = one[: len(one) - window + 1].copy()
        for k in range(1, window):
            run = run * len(ids) + one[k : len(one) - window + 1 + k]
    else:
        run, have = one, 1
        while have < window:
            ranks, run = np.unique(run[:-1] * (len(ids) + 1) + one[have:], return_inverse=True)
            have += 1
    _, inverse, count = np.unique(run, return_inverse=True, return_counts=True)
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count[inverse] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(data: bytes, zip_: zstandard.ZstdCompressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    text = data.decode("utf-8", "replace")
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(WORD_SPACE)]
    return len(words), len(text) - sum(map(text.count, WORD_SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def ratio(data: bytes, zip_: zstandard.ZstdCompressor) -> float:
    return len(data) / len(zip_.compress(data)) if data else 0.0


def verdict(data: bytes, zip_: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK, bad_chunks: float = BAD_CHUNKS) -> tuple[float, int, int, str | None]:
    """Whole ratio, chunks, chunks out of band, and why the text is rejected (None: it isn't)."""
    r = ratio(data, zip_)
    low, high = band(len(data), bands)
    parts = [data[i : i + chunk] for i in range(0, len(data), chunk)] if len(data) > chunk else []
    bad = sum(not b[0] <= ratio(p, zip_) <= b[1] for p in parts if (b := band(len(p), bands)))
    why = "repetitive" if r > high else "incompressible" if data and r < low else "chunks" if bad > bad_chunks * len(parts) else None
    return r, len(parts), bad, why


def rules(docs: DataFrame, bands: tuple = BANDS, chunk: int = CHUNK, bad_chunks: float = BAD_CHUNKS) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, and the compression figures.

    A null text counts as empty; it has no word, so it fails the base rules.  Texts under 64 bytes have no limits of their
    own.  Limits grow with length, as longer texts compress better; `reason` says which rule rejected a text.
    """

    def work(cols: dict) -> dict:
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio", "n_chunks", "bad_chunks", "reason")
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for doc_id, data in zip(cols["doc_id"], cols["text"], strict=True):
            data = data or b""
            base = measure(data, zip_)
            failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
            r, n, bad, why = verdict(data, zip_, bands, chunk, bad_chunks)
            rows.append((doc_id, *base, failed, not failed and why is None, r, n, bad, "base" if failed else why))
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, bad_chunks long, reason string"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)
