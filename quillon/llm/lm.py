"""Language-model scores: add-0.1 unigrams, and online logistic mixing of hashed-context bit predictors.

A byte is coded bit by bit along the Huffman tree of the byte before it.  Five predictors say how likely each bit is: after the last
one, two, three and four bytes, and after the word so far.  All training texts are counted exactly, in a written table, by
what all five see together; a predictor's counts are sums of those.  They are frozen into log-odds of a set bit at every node of
every context, in tables by a hash of the context that grow with the number of different ones.

A bit's probability is the logistic of the weighted sum of the log-odds.  A gate, the kind of the byte before and the bit's depth,
chooses the weights.  First weights are fitted on the counts of all training texts; a document refines its own by a gradient step
after each block, so later blocks are scored with what earlier ones taught.  The end of a text is coded as one more byte.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded_batches, drop_written, remainder, write_out  # noqa: F401  the rule of lower case

END = " "  # no word holds a space
ALPHA = 0.1
#: Predictors: one, two, three, four bytes, and the word so far.
PREDICTORS = 5
#: Cells of a predictor's table for each different (context, byte), at least; and least and most cells, as powers of two.
PER_PAIR, LEAST_BITS, MOST_BITS = 2, 15, 24
#: Parts of a table that are built apart, as a power of two.
PART_BITS = 6
#: Bytes of a document between two steps of its weights, the step, and the weights before any is fitted.
BLOCK, RATE, FIRST = 256, 0.02, 0.3
#: Steps of Newton's method that fit the first weights, and the weight of the start in them, in bits.
ROUNDS, PRIOR = 3, 50.0
#: Counts that are added to the set and unset bits of a cell, and log-odds of the cells' unit; they end at 127 units.
SMOOTH, UNIT = 0.4, 1 / 14
#: Words with their counts that every worker holds, at most; the other words of a document are joined by shuffle.
HOT_WORDS = 150_000
#: Words that a training task counts before it hands them on.
HELD_WORDS = 300_000
#: Different slots that a training task holds before it hands them on, bytes it counts at once, and bytes whose contexts it makes at once.
HELD_SLOTS, COUNTED_BYTES, CONTEXT_BYTES = 1 << 21, 1 << 22, 1 << 18
#: Bytes of all documents side by side that are scored at once.
_STEP_BYTES = 1 << 14
_DEPTHS = 8
_KIND = np.array([1 if chr(b).isalnum() or b >= 128 else 0 if b in b" \t\n\v\f\r" else 2 for b in range(256)])
_FAR = 4
_PAD = b"\n" * _FAR
_ODD = np.uint64(0x9E3779B97F4A7C15)


def contexts(padded: np.ndarray) -> np.ndarray:
    """What precedes every byte after the padding, 56 bits: 24 of a hash of the word so far less its last four bytes, and four bytes."""
    n = len(padded) - _FAR
    four = np.ndarray(n, ">u4", np.ascontiguousarray(padded), 0, (1,)).astype(np.uint64)  # the last byte is the lowest
    # a word's bytes times powers of _ODD from its start, by differences of running sums
    power, back = _powers(len(padded))
    sums = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum((padded + np.uint64(1)) * power, out=sums[1:])
    start = np.arange(1, len(padded))
    start *= _KIND[padded[:-1]] != 1
    start = np.maximum.accumulate(start, out=start)[_FAR - 1 :]  # where the word so far begins
    long = np.flatnonzero(start < np.arange(n))  # it has more than four bytes
    first = start.take(long)
    four[long] |= _mixed((sums.take(long) - sums.take(first)) * back.take(first)) >> np.uint64(40) << np.uint64(32)
    return four


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of _ODD and of its inverse; the last ones are kept."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, pow(int(_ODD), -1, 1 << 64))]
    return [x[:n] for x in _POWERS]


def _mixed(context: np.ndarray) -> np.ndarray:
    h = context * _ODD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


_WORD_MASK = np.array([0xFF, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFFFFFFFF], np.uint64)
_WORD_SIZE = np.arange(1, _FAR + 2, dtype=np.uint64) << np.uint64(56)
#: Letters at the end of two bytes, the last of which is the lower one; and hashes of the contexts of one and two bytes.
_RUN = np.where(_KIND[np.arange(1 << 16) & 255] == 1, np.where(_KIND[np.arange(1 << 16) >> 8] == 1, 2, 1), 0).astype(np.uint8)
_SHORT = _mixed(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(16)
#: Contexts that are hashed at once, so that they stay in a core's cache.
_HASHED = 1 << 14


def hashes(joint: np.ndarray) -> np.ndarray:
    """48 bits of hash of each predictor's context, a row each, from what all see together."""
    out = np.empty((PREDICTORS, len(joint)), np.uint64)
    for at in range(0, len(joint), _HASHED):
        some, to = joint[at : at + _HASHED], out[:, at : at + _HASHED]
        last = (some & np.uint64(0xFFFF)).view(np.int64)
        run = _RUN.take(last)  # letters at the end
        run += _RUN.take((some >> np.uint64(16) & np.uint64(0xFFFF)).view(np.int64)) * (run == 2)
        run = run.astype(np.int64)
        _SHORT.take(last & 255, out=to[0], mode="clip")
        _SHORT.take(last, out=to[1], mode="clip")
        word = some & _WORD_MASK.take(run) | _WORD_SIZE.take(run)
        for c, row in zip((some & np.uint64(0xFFFFFF), some & np.uint64(0xFFFFFFFF), word), to[2:], strict=True):
            np.right_shift(_mixed(c), np.uint64(16), out=row)
    return out


@dataclass
class Code:
    """Huffman codes of a byte after each byte: nodes and bits of each (byte before, byte), one after the other; node 0 is the root."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    gate: np.ndarray  # the kind of the byte before and the depth, which choose the weights

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        """From counts[byte before, byte]; bytes that nothing is known of share the code of all."""
        start, length = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64)
        node: list[int] = []
        bit: list[int] = []
        gate: list[int] = []
        known = np.flatnonzero(counts.sum(1))
        for rows in [*(np.setdiff1d(np.flatnonzero(_KIND == k), known) for k in range(3)), *known.reshape(-1, 1)]:
            if not len(rows):
                continue
            paths = Code._paths(counts[rows[0]] if counts[rows[0]].any() else counts.sum(0))
            long = np.array([len(p) for p in paths])
            start[rows], length[rows] = np.cumsum(long) - long + len(node), long
            node += [n for p in paths for n, _ in p]
            bit += [b for p in paths for _, b in p]
            gate += [_KIND[rows[0]] * _DEPTHS + min(d, _DEPTHS - 1) for p in paths for d in range(len(p))]
        return Code(start.ravel(), length.ravel(), np.array(node), np.array(bit, np.float32), np.array(gate))

    @staticmethod
    def _paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
        heap = [(float(n) + 1 / 256, b, None) for b, n in enumerate(counts)]
        heapq.heapify(heap)
        made = 256
        while len(heap) > 1:
            x, y = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (x[0] + y[0], made, (x, y)))
            made += 1
        paths: list[list] = [[] for _ in range(256)]
        todo = [(heap[0], [])]
        while todo:
            (_, name, halves), path = todo.pop()
            if halves is None:
                paths[name] = path
            else:
                todo += [(half, [*path, (made - 1 - name, b)]) for b, half in enumerate(halves)]
        return paths

    def steps(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of (byte before << 8 | byte): lengths of the codes, and the place in node, bit and gate of each of their bits."""
        long = self.length.take(pair)
        step = np.repeat(self.start.take(pair) - np.cumsum(long) + long, long)
        step += np.arange(len(step))
        return long, step


def _base(hashed: np.ndarray, bits: int) -> np.ndarray:
    """Where a context's cells are in a table of 2 ** bits; its nodes are the 256 places around."""
    return (hashed >> np.uint64(48 - bits)).view(np.int64)


def _size_bits(pairs: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (PER_PAIR * max(1, pairs) - 1).bit_length()))


def log_odds(unset: np.ndarray, set_: np.ndarray) -> np.ndarray:
    return np.rint(np.log((set_ + SMOOTH) / (unset + SMOOTH)) / UNIT).clip(-127, 127).astype(np.int8)


@dataclass
class Mixer:
    code: Code
    tables: list[np.ndarray]  # log-odds in units; one after the other in flat
    weights: np.ndarray  # (kinds * depths, predictors)

    def __post_init__(self) -> None:
        self.flat = np.concatenate(self.tables)
        self.ends = np.cumsum([len(t) for t in self.tables])
        self.tables = np.split(self.flat, self.ends[:-1])

    def __reduce__(self) -> tuple:
        return Mixer, (self.code, self.tables, self.weights)

    def bases(self, hashed: np.ndarray) -> np.ndarray:
        """Where the contexts' cells are in flat, a row for each predictor."""
        for k, (row, end) in enumerate(zip(hashed, self.ends.tolist(), strict=True)):
            size = len(self.tables[k])
            row >>= np.uint64(48 - size.bit_length() + 1)
            row += np.uint64(end - size)
        return hashed.view(np.int64)

    def units(self, bases: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log-odds in units, a row for each predictor, at these steps of codes after contexts with these bases."""
        bases ^= self.code.node.take(step)
        return self.flat.take(bases).astype(np.float32)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text with its end.  Texts of about the same length go side by side; each is scored by itself."""
        total = np.zeros(len(texts))
        order, group, held = sorted(range(len(texts)), key=lambda i: len(texts[i])), [], 0
        for i in order:
            if group and held + len(texts[i]) > 1 << 19:
                total[group] = self._together([texts[j] for j in group])
                group, held = [], 0
            group.append(i)
            held += len(texts[i])
        if group:
            total[group] = self._together([texts[j] for j in group])
        return total

    def _together(self, texts: list[bytes]) -> np.ndarray:
        buf = np.frombuffer(b"".join(_PAD + t + b"\0" for t in texts), np.uint8)
        lens = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(lens + _FAR) - lens - _FAR  # of the texts among bytes that have enough before them
        bases = self.bases(hashes(contexts(buf)))
        pair = buf[_FAR - 1 : -1].astype(np.int64) << 8 | buf[_FAR:]
        signs = (2 * self.code.bit - 1) * np.float32(UNIT)
        gates, m = self.weights.shape
        w = np.repeat(self.weights.T[:, :, None].astype(np.float32), len(texts), 2)  # (predictor, gate, text)
        total = np.zeros(len(texts))
        for at in range(0, int(lens.max()), BLOCK):
            live = np.flatnonzero(lens > at)
            for part in np.array_split(live, -(-len(live) * BLOCK // _STEP_BYTES)):
                n = np.minimum(lens[part] - at, BLOCK)
                first = np.cumsum(n) - n
                i = np.arange(int(n.sum())) + np.repeat(starts[part] + at - first, n)
                long, step = self.code.steps(pair.take(i))
                # bits in order of their weights: gate, then text
                gate = self.code.gate.take(step)
                order = np.argsort(gate.astype(np.uint8), kind="stable")
                gate *= len(part)
                gate += np.repeat(np.arange(len(part)), np.add.reduceat(long, first))
                many = np.bincount(gate)
                cell = np.flatnonzero(many)
                many = many.take(cell)
                edge, step = np.cumsum(many) - many, step.take(order)
                st, sign = self.units(bases.take(np.repeat(i, long).take(order), 1), step), signs.take(step)
                mine = w[:, :, part].reshape(m, -1)
                z = np.einsum("ki,ki->i", np.repeat(mine.take(cell, 1), many, axis=1), st)
                z *= sign  # log-odds of what is there
                e = np.exp(-np.abs(z))
                total[part] += np.bincount(cell % len(part), np.add.reduceat(np.log1p(e) - np.minimum(z, 0), edge, dtype=np.float64), len(part))
                if at + BLOCK < int(lens[part].max()):  # something is left that the step can serve
                    st *= sign / (1 + np.exp(np.minimum(z, np.float32(80))))  # with the probability of what isn't there
                    grad = np.add.reduceat(st, edge, axis=1)
                    mine[:, cell] = np.clip(mine[:, cell] + np.float32(RATE / 16) * grad, -4, 4)
                    w[:, :, part] = mine.reshape(m, gates, len(part))
        return total / np.log(2)


def _summed(slots: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different slots, sorted, with the sums of n, or how often each occurs."""
    if n is None:
        slots = np.sort(slots)
    else:
        order = np.argsort(slots, kind="stable")
        slots, n = slots[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(slots)), bool), slots[1:] != slots[:-1]]))
    return slots[first], np.diff(first, append=len(slots)) if n is None else np.add.reduceat(n, first) if len(first) else n


def _padding(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with their ends, one after the other with padding, and which of the bytes after the first padding are theirs."""
    buf = np.frombuffer(b"".join(_PAD + t + b"\0" for t in texts), np.uint8)
    real = np.ones(len(buf) - _FAR, bool)
    ends = np.cumsum([len(t) + 1 + _FAR for t in texts])
    for k in range(_FAR):
        real[ends[:-1] + k - _FAR] = False  # the padding of the next text
    return buf, real


def _slots(texts: list[bytes]) -> np.ndarray:
    """The slots of all bytes of the texts and of their ends: 56 bits of contexts, then the byte."""
    out, first = [], 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < CONTEXT_BYTES):
            size += len(texts[last])
            last += 1
        buf, real = _padding(texts[first:last])
        out.append((contexts(buf) << np.uint64(8) | buf[_FAR:])[real])
        first = last
    return np.concatenate(out)


def _lower(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case; null is empty."""
    return pc.ascii_lower(texts.cast(pa.string()).fill_null(""))


def _words(lower: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All words of the texts and the number of the text of each; white space is that of bytes.split()."""
    lists = pc.ascii_split_whitespace(lower)
    words = lists.flatten()
    real = pc.not_equal(words, "")
    return words.filter(real), pc.list_parent_indices(lists).filter(real)


def _word_counts(lower: pa.Array) -> pa.Table:
    """(word, n) of texts."""
    counted = pc.value_counts(_words(lower)[0])
    return pa.table([counted.field("values"), counted.field("counts")], ["word", "n"])


def gather(docs: DataFrame) -> DataFrame:
    """(word, slot, n) from docs (text): word counts (slot null) and counts of what precedes a byte, with it (word null), by task.

    Counts are handed on in turns, so a task's memory doesn't grow with its input.
    """
    schema = pa.schema([("word", pa.string()), ("slot", pa.int64()), ("n", pa.int64())])

    def batch(slots: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()), pa.array(slots.view(np.int64)), pa.array(n, pa.int64())], schema=schema)

    def summed(words: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(words).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.table([t["word"], t["n_sum"]], ["word", "n"])

    def handed(words: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in words.to_batches():
            yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.int64()), b.column(1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Table] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            lower = _lower(b.column(0))
            words += [_word_counts(lower), pa.table([[END], [b.num_rows]], ["word", "n"])]
            if sum(t.num_rows for t in words) > 2 * HELD_WORDS:
                words = [summed(words)]
                if words[0].num_rows > HELD_WORDS:
                    yield from handed(words.pop())
            texts = lower.cast(pa.binary()).to_pylist()
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) < COUNTED_BYTES):
                    size += len(texts[last])
                    last += 1
                held.append(_summed(_slots(texts[first:last])))
                if sum(len(slots) for slots, _ in held) > HELD_SLOTS:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD_SLOTS // 2:
                        yield batch(*held.pop())
                first = last
        if words:
            yield from handed(summed(words))
        if held:
            yield batch(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    bounded_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word string, slot long, n long")


def _many(batches: Iterator[pa.RecordBatch], rows: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """Columns of so many rows, about, at a time."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy() for c in b.columns])
        if sum(len(x[0]) for x in held) >= rows:
            yield list(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield list(map(np.concatenate, zip(*held, strict=True)))


def pairs(slots: DataFrame) -> DataFrame:
    """(k, key, n): counts of each predictor's pairs of context and byte; key is 48 bits of hash, the byte before and the byte."""
    schema = pa.schema([("k", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, n in _many(batches):
            slot = slot.view(np.uint64)
            joint = slot >> np.uint64(8)
            for k, h in enumerate(hashes(joint)):
                key, m = _summed(h << np.uint64(16) | slot & np.uint64(0xFFFF), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), pa.array(m)], schema=schema)

    return slots.select("slot", "n").mapInArrow(run, "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))


def tables(counted: DataFrame, code: Code, bits: list[int]) -> list[np.ndarray]:
    """Each predictor's table of 2 ** bits[k] cells from the counts of its pairs; parts of tables are built apart."""
    box = counted.sparkSession.sparkContext.broadcast(code)
    schema = pa.schema([("k", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for ks, parts, keys, n in _many(batches):
            for name in {*zip(ks.tolist(), parts.tolist(), strict=True)}:
                mine = np.flatnonzero((ks == name[0]) & (parts == name[1]))
                key = keys[mine].view(np.uint64)
                size = bits[name[0]] - PART_BITS
                base = _base(key >> np.uint64(16), bits[name[0]]) & (1 << size) - 1
                long, step = box.value.steps((key & np.uint64(0xFFFF)).view(np.int64))
                place = np.repeat(base, long) ^ box.value.node[step]
                if name not in seen:
                    seen[name] = np.zeros(2 << size)
                seen[name] += np.bincount(2 * place + (box.value.bit[step] > 0), np.repeat(n[mine], long), 2 << size)
        for (k, part), x in seen.items():
            cells = log_odds(x[::2], x[1::2]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([cells], pa.binary())], schema=schema)

    part = F.shiftrightunsigned("key", 64 - PART_BITS).cast("int").alias("part")
    dealt = counted.select("k", part, "key", "n").repartition(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "part")
    out = [np.zeros(1 << b, np.int8) for b in bits]
    for r in dealt.mapInArrow(run, "k int, part int, cells binary").toLocalIterator():  # the tables themselves
        size = 1 << bits[r["k"]] - PART_BITS
        out[r["k"]][r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["cells"], np.int8)
    return out


def fitted(slots: DataFrame, mixer: Mixer) -> np.ndarray:
    """The mixer's weights after a step of Newton's method on the bits of all counted slots, towards fewer bits in all.

    The weights before count as PRIOR bits, so that gates which were hardly seen stay.  Sums are of whole numbers, so they don't
    hang on how rows are dealt.
    """
    box, unit, (gates, m) = slots.sparkSession.sparkContext.broadcast(mixer), 1 << 20, mixer.weights.shape
    cells = gates * m * (m + 1)
    schema = pa.schema([("i", pa.int32()), ("s", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((gates, m * (m + 1)))
        mix = box.value
        for slot, n in _many(batches, 1 << 16):
            slot = slot.view(np.uint64)
            long, step = mix.code.steps((slot & np.uint64(0xFFFF)).view(np.int64))
            gate = mix.code.gate.take(step)
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            gate, step, at = gate.take(order), step.take(order), np.repeat(np.arange(len(slot)), long).take(order)
            st = mix.units(mix.bases(hashes(slot >> np.uint64(8))).take(at, 1), step).astype(np.float64)
            st *= UNIT
            y, many = mix.code.bit.take(step), n.take(at)
            p = 1 / (1 + np.exp(-(mix.weights.T.take(gate, 1) * st).sum(0)))
            err, var = many * (y - p), st * (many * p * (1 - p))
            edge = np.searchsorted(gate, np.arange(gates + 1)).tolist()
            for g, (i, j) in enumerate(zip(edge, edge[1:], strict=False)):
                total[g, :m] += st[:, i:j] @ err[i:j]
                total[g, m:] += (var[:, i:j] @ st[:, i:j].T).ravel()
        whole = [int(round(x)) for x in (total.ravel() * unit).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(whole, pa.decimal128(38, 0))], schema=schema)

    sums = slots.select("slot", "n").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # one row a sum
    box.unpersist()
    total = np.zeros(cells)
    for r in sums:
        total[r["i"]] = float(r["s"]) / unit
    total = total.reshape(gates, -1)
    hess = total[:, m:].reshape(gates, m, m) + np.eye(m) * PRIOR
    step = np.linalg.solve(hess, total[:, :m, None])[:, :, 0]
    return np.clip(mixer.weights + step, 0, 2).astype(np.float32)


def train(docs: DataFrame) -> tuple[Mixer, DataFrame, int, int]:
    """The mixer, the table of word counts (word, c), and all and different tokens of the training texts (null: empty)."""
    seen = write_out(gather(docs), "lm-counts")
    vocabulary = write_out(seen.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    slots = write_out(seen.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")), "lm-slots")
    drop_written(seen)
    counted = write_out(pairs(slots), "lm-pairs")
    many = {r["k"]: r["m"] for r in counted.groupBy("k").agg(F.count("*").alias("m")).collect()}  # one row a predictor
    two = np.zeros((256, 256))
    for r in counted.where("k = 0").select(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        two[r["pair"] >> 8, r["pair"] & 255] = r["n"]  # at most 65,536 rows
    code = Code.of(two)
    mixer = Mixer(code, tables(counted, code, [_size_bits(many.get(k, 0)) for k in range(PREDICTORS)]), np.full((3 * _DEPTHS, PREDICTORS), FIRST, np.float32))
    drop_written(counted)
    for _ in range(ROUNDS if tokens else 0):
        mixer = Mixer(code, mixer.tables, fitted(slots, mixer))
    drop_written(slots)
    return mixer, vocabulary, int(tokens), int(distinct)


def score(docs: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Training texts are those whose crc32(doc_id) mod 10 is not 0.  A null text is empty: its only token is the end.  Scores
    are log10 probabilities.  With no training text, N and V are 0 and the mixer's predictors say nothing.
    """
    held = remainder(F.col("doc_id"), 10) == 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mixer, vocabulary, n, v = train(docs.where(~held))
    steps = vocabulary.groupBy(F.floor(F.log2("c")).alias("power")).count().orderBy(F.desc("power")).collect()  # at most 63 rows
    least, some = 1 << 62, 0
    for r in steps:
        if some + r["count"] > hot_words:
            break
        least, some = 1 << r["power"], some + r["count"]
    hot = vocabulary.where(F.col("c") >= least).toPandas()
    floor = ALPHA / (n + ALPHA * (v + 1)) if n else 1.0
    logs = np.log10((hot["c"].to_numpy().astype(np.float64) + ALPHA) / (n + ALPHA * (v + 1))) if n else np.zeros(0)
    box = docs.sparkSession.sparkContext.broadcast((mixer, pa.array(hot["word"].tolist(), pa.string()), logs))
    none_is_hot = least == 1
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64()), ("n_bytes", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, known, log = box.value
        unseen = float(np.log10(floor))
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            lower = _lower(b.column(2))
            words, text = _words(lower)
            words = pa.concat_arrays([words, pa.array([END] * size, pa.string())])
            text = np.concatenate([text.to_numpy(), np.arange(size)])
            at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
            there = at >= 0
            tokens, n_known = (np.bincount(x, minlength=size) for x in (text, text[there]))
            base = np.bincount(text[there], log[at[there]], size)
            if none_is_hot:  # every counted word is here, so the others have none
                base += unseen * (tokens - n_known)
            bits = mix.bits(lower.cast(pa.binary()).to_pylist())
            made = [b.column(0), b.column(1), pa.array(tokens), pa.array(n_known), pa.array(base), pa.array(bits), pc.binary_length(lower).cast(pa.int64()), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, schema=out)
            if not none_is_hot and not there.all():
                rest = pa.table([b.column(0).take(pa.array(text[~there])), words.filter(pa.array(~there))], ["row", "word"])
                rare = rest.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["row", "word", "n"])
                for r in rare.to_batches():
                    yield pa.RecordBatch.from_arrays([r.column(f.name) if f.name in ("row", "word", "n") else pa.nulls(r.num_rows, f.type) for f in out], schema=out)

    bounded_batches(docs.sparkSession)
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, bits double, n_bytes long, word string, n long"
    found = write_out(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema), "lm-scores")
    rest = found.where("word is not null").select("row", "word", "n").join(vocabulary, "word", "left")
    each = F.log10((F.coalesce("c", F.lit(0)) + ALPHA) / (n + ALPHA * (v + 1)) if n else F.lit(1.0))
    more = rest.groupBy("row").agg(F.sum(each * F.col("n")).alias("base_more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known_more"))
    return found.where("word is null").join(more, "row", "left").select(
        "doc_id",
        (remainder(F.col("doc_id"), 10) == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"),
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
