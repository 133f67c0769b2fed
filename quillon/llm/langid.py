"""Language ID by prediction by partial matching over bytes.

Each language has counts of what follows every context of up to four bytes, learned from a bounded sample of labelled rows
and then frozen.  A context that has seen n symbols, d of them distinct, gives a seen symbol count / (n + d) and escapes with
d / (n + d) to the context one byte shorter, whose probabilities are rescaled without the symbols already seen; below the
empty context all bytes are alike.  A text's code length under a language is the exact sum of -log2 of these over its bytes;
the shortest code wins.

No context is left out.  The tables are sparse: one row for each (context, byte) that a language of a group has seen, found by
hash, with that byte's length in each of the group's languages; a byte that none has seen after the longest context is found
after a shorter one, and costs the escapes in between besides.  Tables of a few languages each are built by executors.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, bounded_batches, map_rows, remainder, row_of

ORDER = 4
#: Labelled rows of each language that the classifier is fitted on, at most, taken by a hash of their id; and characters after
#: which no further row is taken.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 1 << 21
#: Languages whose tables are built together.
GROUP = 8
UNKNOWN = "und"
#: A text whose best language has less than this share of the likelihoods is rejected in the pipeline.
LEAST_SCORE = 0.5
_PAD = b"\n" * ORDER
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def _grams(data: bytes) -> np.ndarray:
    """Five bytes that end at each byte after the first four, as integers."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    g = a[:-ORDER].copy()
    for k in range(1, ORDER + 1):
        g = g << 8 | a[k : len(a) - ORDER + k]
    return g


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, text): a bounded number of labelled rows of each language whose crc32(doc_id) mod 4 is not 2, whole texts."""
    able = docs.where((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    keyed = able.select("lang", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.xxhash64("text").alias("t"), F.length("text").alias("n"))
    first = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    picked = first.withColumn("before", before).where(F.col("before") < chars).select("lang", F.col("doc_id").alias("id"), "t").distinct()
    # `rows` ids for each language, whatever the corpus
    same = (F.col("a.lang") == F.col("p.lang")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("t"))
    return able.alias("a").join(F.broadcast(picked).alias("p"), same, "left_semi").select("lang", "text")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of labelled rows (lang, text)."""

    def count(cols: dict) -> dict:
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        by: dict[bytes, list[bytes]] = {}
        for lang, text in zip(cols["lang"], cols["text"], strict=True):
            by.setdefault(lang, []).append(_PAD + normalised(text))
        for lang, texts in by.items():
            g, n = np.unique(np.concatenate([_grams(t) for t in texts]), return_counts=True)  # an empty text has none
            out["lang"] += [lang.decode()] * len(g)
            out["gram"] += g.tolist()
            out["n"] += n.tolist()
        return out

    return map_rows(rows.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Keys:
    """Places of integer keys, by open addressing in an array at least twice as long."""

    def __init__(self, keys: np.ndarray, slots: np.ndarray | None = None):
        self.keys = keys
        if slots is None:
            slots = np.full(1 << (2 * max(1, len(keys)) - 1).bit_length(), -1, np.int32)
            todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys, len(slots))
            while len(todo):
                free = slots[at] < 0
                slots[at[free]] = todo[free]  # of those that meet at a place, the last one has it
                left = slots[at] != todo
                todo, at = todo[left], (at[left] + 1) & (len(slots) - 1)
        self.slots = slots

    @staticmethod
    def _home(keys: np.ndarray, size: int) -> np.ndarray:
        return (keys.astype(np.uint64) * _ODD >> np.uint64(65 - size.bit_length())).view(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        at = self._home(wanted, len(self.slots))
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != wanted))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.slots) - 1)
            got = self.slots[at]
            out[open_] = got
            on = (got >= 0) & (self.keys[got] != wanted[open_])
            open_, at = open_[on], at[on]
        return out


@dataclass
class Tables:
    """Of a group of languages: what each (context, byte) costs, and the escapes from each context down to none."""

    pairs: Keys  # a one, the context's bytes, the byte
    cost: np.ndarray  # (pair, language): bits, less the escapes of the pair's own context
    contexts: Keys  # a one, the context's bytes
    escapes: np.ndarray  # (context, language)
    unseen: float = 8.0  # bits of a byte below the empty context

    def lengths(self, five: np.ndarray) -> np.ndarray:
        """Bits of each byte after its four, in each language; five: those five bytes as an integer."""
        out = np.full((len(five), self.cost.shape[1]), self.unseen, np.float32)
        todo = np.arange(len(five))
        for k in range(ORDER, -1, -1):
            key = five[todo] & ((1 << 8 * (k + 1)) - 1) | 1 << 8 * (k + 1)
            got = self.pairs.find(key)
            hit = got >= 0
            out[todo[hit]] = self.cost[got[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        todo, four = np.arange(len(five)), five >> 8
        for k in range(ORDER, -1, -1):  # the longest known context
            got = self.contexts.find(four[todo] & ((1 << 8 * k) - 1) | 1 << 8 * k)
            hit = got >= 0
            out[todo[hit]] += self.escapes[got[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


@dataclass
class Model:
    languages: list[str]
    groups: list[Tables]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, (texts, languages); texts are normalised."""
        total = np.zeros((len(texts), len(self.languages)))
        for first, last in _chunks([len(t) for t in texts]):
            lens = np.array([len(t) for t in texts[first:last]])
            full = np.flatnonzero(lens)
            if not len(full):
                continue
            five = _grams(b"".join(_PAD + texts[first + i] for i in full))
            starts = np.cumsum(lens[full] + ORDER) - (lens[full] + ORDER)
            edges = np.stack([starts, starts + lens[full]], 1).ravel()
            cost = np.concatenate([g.lengths(five) for g in self.groups], 1)
            cost = np.concatenate([cost, np.zeros((1, cost.shape[1]), cost.dtype)])
            total[first + full] = np.add.reduceat(cost, edges, axis=0, dtype=np.float64)[::2]
        return total


def _chunks(lens: list[int], most: int = 1 << 19) -> list[tuple[int, int]]:
    out, first, held = [], 0, 0
    for i, n in enumerate(lens):
        if held and held + n > most:
            out.append((first, i))
            first, held = i, 0
        held += n + ORDER
    return [*out, (first, len(lens))] if lens else []


def fit(many: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Tables:
    """Tables of `many` languages; lang is the number of each gram's language, n how often the gram occurs there."""
    keys: list[np.ndarray] = []
    costs: list[np.ndarray] = []
    contexts: list[np.ndarray] = []
    escapes: list[np.ndarray] = []
    for k in range(ORDER + 1):
        low = (1 << 8 * (k + 1)) - 1
        pair, inv = np.unique(gram & low, return_inverse=True)
        count = np.bincount(inv * many + lang, n, len(pair) * many).reshape(-1, many)
        context, of = np.unique(pair >> 8, return_inverse=True)
        had = count > 0
        each = lambda x, of=of, m=len(context): np.stack([np.bincount(of, x[:, j], m) for j in range(many)], 1)
        total, distinct = each(count), each(had)
        if k:
            shorter = bits[np.searchsorted(keys[-1], pair & low >> 8)]  # what the bytes cost after one byte less  # noqa: F821
            below = escapes[-1][np.searchsorted(contexts[-1], context & low >> 16)]
        else:
            shorter, below = np.full((len(pair), many), 8.0), np.zeros((len(context), many))
        rest = np.maximum(1 - each(np.where(had, np.exp2(-shorter), 0)), 1e-9)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(total > 0, np.log2(rest) - np.log2(distinct / (total + distinct)), 0.0)
            bits = np.where(had, np.log2((total + distinct)[of]) - np.log2(count), out[of] + shorter)
        keys.append(pair)
        contexts.append(context)
        escapes.append(below + out)
        costs.append(bits - escapes[-1][of])
    marked = lambda found, extra: np.concatenate([x | 1 << 8 * (k + extra) for k, x in enumerate(found)])
    return Tables(Keys(marked(keys, 1)), np.concatenate(costs).astype(np.float32), Keys(marked(contexts, 0)), np.concatenate(escapes).astype(np.float32))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, group: int = GROUP) -> Model | None:
    """The model of a bounded sample; None if no row can teach anything.  Any number of languages: tables grow in proportion."""
    spark = docs.sparkSession
    seen = gram_counts(sample(docs, rows))
    languages = sorted(r["lang"] for r in docs.where(F.col("lang").isNotNull()).select("lang").distinct().collect())  # one row a language
    number = spark.createDataFrame([(name, k // group, k % group) for k, name in enumerate(languages)], "lang string, part int, k long")

    def build(part: pa.Table) -> pa.Table:
        k = part["k"].to_numpy()
        mine, k = np.unique(k, return_inverse=True)  # languages of this group that the sample has
        t, out = fit(len(mine), k, part["gram"].to_numpy(), part["n"].to_numpy().astype(float)), io.BytesIO()
        np.savez(out, mine=mine, pairs=t.pairs.keys, cost=t.cost, contexts=t.contexts.keys, escapes=t.escapes)
        return pa.table({"part": pa.array([part["part"][0].as_py()], pa.int32()), "tables": pa.array([out.getvalue()], pa.binary())})

    counted = seen.join(F.broadcast(number), "lang").select("part", "k", "gram", "n")
    built = counted.groupBy("part").applyInArrow(build, "part int, tables binary").orderBy("part").collect()  # tables of the bounded sample
    names, groups = [], []
    for r in built:
        with np.load(io.BytesIO(r["tables"])) as x:
            names += [languages[r["part"] * group + int(k)] for k in x["mine"]]
            groups.append(Tables(Keys(x["pairs"]), x["cost"], Keys(x["contexts"]), x["escapes"]))
    return Model(names, groups) if names else None


def _judge(m: Model | None, texts: list[bytes | None]) -> tuple[list, list, list]:
    """lang_pred, score and bits_per_byte of each text."""
    pred, score, per_byte = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
    rows = [i for i, t in enumerate(texts) if m is not None and t is not None and has_letter(t)]
    known = [normalised(texts[i]) for i in rows]
    for i, t, bits in zip(rows, known, m.lengths(known) if rows else (), strict=True):
        best = int(bits.argmin())
        pred[i] = m.languages[best]
        score[i] = float(1 / np.exp2(-np.minimum(bits - bits[best], 1000)).sum())
        per_byte[i] = float(bits[best] / len(t))
    return pred, score, per_byte


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every row; whole texts are scored, and only they.

    Null texts and texts without a letter give `und`, score 0 and null bits_per_byte, and so does everything if there is no
    model.  score is the winner's share of the likelihoods; ties go to the first language in order of name.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def work(cols: dict) -> dict:
        pred, score, per_byte = _judge(box.value, cols["text"])
        return {"doc_id": cols["doc_id"], "lang_pred": pred, "score": score, "bits_per_byte": per_byte}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, lang_pred string, score double, bits_per_byte double")


def accepted(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language by a score of `least` or more."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid.accepted")
        for b in batches:
            texts = [None if t is None else t.encode() for t in b.column(1).to_pylist()]
            pred, score, _ = _judge(box.value, texts)
            kept = pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0)], ["row"]).filter(kept)

    rows = docs.select(row_of(docs).alias("row"), "text")
    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
