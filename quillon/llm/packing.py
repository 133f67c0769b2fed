"""Best-fit packing by minimum bin slack.

Lengths are at most the sequence's, so their histogram is bounded whatever the corpus.  The driver plans on it: the longest
length left opens a bin, a bitset subset-sum over the lengths left finds the fullest filling, and that bin is used as often as
its lengths last.  Executors then look up each piece's place by its rank among pieces of its length.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, map_rows, write_out

CAPACITY, END_ID = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Words that a worker keeps ids of, at most; beyond it, rarer ones are encoded again.
CACHED_WORDS = 500_000
#: Pieces of one length that are ranked together, about.
RANKED = 20_000
#: Word parts of Latin-1 text by the tokenizer's own pattern (letters, one digit, or other characters but white space).
_LETTER = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9²³¹¼½¾]|[^\s{_LETTER}0-9²³¹¼½¾]+")
_ODD = re.compile("[\x00-\x20\x7f-\xa0Ā-\U0010ffff]|<\\|")


class Encoder:
    """Ids of whole texts, as little-endian bytes; equal to the tokenizer's own, but each word is encoded once.

    The tokenizer drops white space and never joins what stands on both sides of it, so a text's ids are those of its words.
    Words of printable Latin-1 are cut and encoded directly; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.cached = self.whole.model, cached
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.shown = str.maketrans({chr(b): chr(c) for b, c in moved.items()})  # byte-level alphabet
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.shown))
        ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        if len(self.parts) < self.cached:
            self.parts[part] = ids
        return ids

    def _word(self, key: bytes) -> bytes:
        word = key.decode()
        if _ODD.search(word):
            ids = b"".join([i.to_bytes(4, "little") for i in self.whole.encode(word, add_special_tokens=False).ids])
        else:
            get = self.parts.get
            ids = b"".join([get(p) or self._part(p) for p in _PARTS.findall(word.lower())])
        if len(self.words) < self.cached:
            self.words[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if text.isascii() or max(text) < "Ā":
            text = text.lower()
        get, word = self.words.get, self._word
        out = []
        for w in text.encode().split():
            ids = get(w)
            out.append(word(w) if ids is None else ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One for each worker, which goes with its words when the worker begins other work: it may take 200 MB."""
    return kept(path, lambda: Encoder(path))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and END_ID, cut where longer than capacity."""

    def work(cols: dict) -> dict:
        enc = encoder(tokenizer or tokenizer_path())
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        step = 4 * capacity
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            ids = enc.encode((text or b"").decode("utf-8", "replace")) + END_ID.to_bytes(4, "little")
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                for name, v in (("doc_id", doc_id), ("piece", k), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                    out[name].append(v)
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """Lengths (with counts, at most those left) whose sum is the largest that fits in room; longer ones are preferred."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((k for k, n in left.items() if n and k <= room), reverse=True):
        n, some = min(left[length], room // length), 1
        while n > 0:  # counts by powers of two
            take = min(some, n)
            before, reach = reach, (reach | reach << (length * take)) & mask
            if reach != before:
                steps.append((before, length, take))
            n, some = n - take, some * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank beyond, pieces in a bin, first bin, offset) for all of the pieces that counts has."""
    left, rows, used_of, bin_ = dict(counts), [], dict.fromkeys(counts, 0), 0
    for top in sorted(counts, reverse=True):
        while left[top]:
            left[top] -= 1
            used = fullest(left, capacity - top)
            left[top] += 1
            used[top] = used.get(top, 0) + 1
            times, offset = min(left[k] // n for k, n in used.items()), 0
            for length, n in sorted(used.items(), reverse=True):
                rows.append((length, used_of[length], used_of[length] + n * times, n, bin_, offset))
                used_of[length] += n * times
                left[length] -= n * times
                offset += n * length
            bin_ += times
    return rows


def place(parts: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """parts (with length) plus sequence_id and offset.  Equal rows are interchangeable; reruns agree."""
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    if not counts:
        return parts.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    groups = max(1, sum(counts.values()) // ranked)
    dealt = parts.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = dealt.groupBy("length", "dealt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("dealt")) - F.col("count"))
    inside = F.row_number().over(Window.partitionBy("length", "dealt").orderBy("doc_id", "piece", "ids_crc32"))
    ranks = dealt.withColumn("inside", inside).join(before.drop("count"), ["length", "dealt"]).withColumn("rank", F.col("inside") + F.col("before") - 1)
    rows = spark.createDataFrame(plan(counts, capacity), "length long, low long, high long, many long, bin long, off long")
    # the plan's rows are bounded by the number of lengths, not by the corpus
    found = ranks.alias("r").join(F.broadcast(rows).alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    within = F.col("rank") - F.col("low")
    return found.select(
        *[F.col(f"r.{c}") for c in parts.columns],
        (F.col("bin") + F.floor(within / F.col("many"))).alias("sequence_id"),
        (F.col("off") + within % F.col("many") * F.col("r.length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is the end id alone.  Repeated rows are packed as often as they occur.
    """
    return place(write_out(pieces(docs, tokenizer, capacity), "pieces"), capacity)
