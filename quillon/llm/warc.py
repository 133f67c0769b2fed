"""WARC archives of pages, read back and indexed by an external merge.

Archives are plain WARC/1.1 files that Spark's text writer makes, with the payload of the page with the smallest id stored once
and the others as revisits.  Every record's first field is the archive's own id, drawn after the pages were written, so the
reader can part the files at it whatever the payloads hold; lengths and digests are checked again.

Captures are sorted where they were read, which gives runs, and the runs are written; they are dealt by ranges of (URL key, time,
page), of a bounded number of rows each, and each range merges its parts of the runs with a loser tree, so the parts one after the
other are the global order.

`records` reads any archive, by the lengths that its records state.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, write_out

#: First pages of repeated payloads up to this number are broadcast (some MB); beyond it they are joined by shuffle.
BROADCAST_FIRSTS = 100_000
#: Captures that one range merges, about.
RANGE_ROWS = 200_000
_EPOCH = 1_577_836_800  # pages have no time: one second for each id from 2020 on, in turns of ten years
_TURN = 315_360_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_FIELDS = "page_id long, url string, captured string, record_type string, refers_to long, payload string, payload_bytes long, payload_digest string, file string"


def digest(payload: Column) -> Column:
    """SHA-1 of a text's UTF-8 bytes in upper-case base32."""
    hexed = F.sha1(F.encode(payload, "UTF-8"))
    fives = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host names from the right, joined by commas, then the path and query, lower-cased; no scheme, `www.` or fragment."""
    parts = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:www\.)?([^/?#]*)([^#]*)"
    u = F.lower(F.coalesce(url, F.lit("")))
    host = F.array_join(F.reverse(F.split(F.regexp_extract(u, parts, 1), r"\.")), ",")
    return F.concat(host, F.lit(")"), F.regexp_extract(u, parts, 2))


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def write(pages: DataFrame, path: str) -> str:
    """Writes pages(page_id, url, html) below path; returns the archive's id.

    A null html is an empty payload.  Of equal payloads the smallest page_id is the response (rows that repeat it too), all
    other rows are revisits; where no row has a page_id, all are responses.  Line breaks in a URL become spaces.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate("url", "\r\n", "  ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", digest(F.col("html")))
    firsts = write_out(p.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "payload-firsts")
    side = F.broadcast(firsts) if firsts.count() <= BROADCAST_FIRSTS else firsts
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    seconds = F.pmod(F.coalesce("page_id", F.lit(0).cast("long")), F.lit(_TURN)) + _EPOCH
    http = F.concat(F.lit(_HTTP), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    archive = uuid.uuid4().hex

    def field(name: str, value: Column | str, when: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))
        return F.coalesce(line if when is None else F.when(when, line), F.lit(""))

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Archive", archive),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"))),
        field("WARC-Page-ID", F.col("page_id").cast("string")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Date", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("WARC-Profile", _PROFILE, revisit),
        field("WARC-Refers-To", _record_id(F.col("first")), revisit),
        field("WARC-Refers-To-Page-ID", F.col("first").cast("string"), revisit),
        field("Content-Type", "application/http;msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )
    p.join(side, "digest", "left").select(record.alias("value")).write.option("lineSep", "\r\n").text(path)
    return archive


def read(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Records of an archive; fails where a length or a digest is wrong.  The payload of a revisit is null."""
    parting = f"\r\n\r\nWARC/1.1\r\nWARC-Archive: {archive}\r\n"
    raw = spark.read.option("lineSep", parting).text(path).select("value", F.col("_metadata.file_name").alias("file"))
    text = F.regexp_replace("value", "^WARC/1.1\r\nWARC-Archive: [0-9a-f]{32}\r\n", "")
    at = F.instr("text", "\r\n\r\n")
    head = F.concat(F.lit("\r\n"), F.expr("substring(text, 1, at - 1)"), F.lit("\r\n"))
    named = raw.select("file", text.alias("text")).withColumn("at", at).select("file", head.alias("head"), F.expr("substring(text, at + 4)").alias("block"))

    def field(name: str) -> Column:
        v = F.regexp_extract("head", f"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.when(F.contains("head", F.lit(f"\r\n{name}: ")), v)

    kind = field("WARC-Type")
    length = field("Content-Length").cast("long")
    # the last record of a file still has the four bytes that end it
    trimmed = F.when(F.octet_length("block") == length + 4, F.expr("substring(block, 1, length(block) - 4)")).otherwise(F.col("block"))
    cut = named.select("file", "head", trimmed.alias("block"), length.alias("length"), kind.alias("record_type"))
    start = F.instr("block", "\r\n\r\n")
    stated = F.regexp_extract(F.expr("substring(block, 1, 200)"), "\r\nContent-Length: ([0-9]+)\r\n", 1).cast("long")
    parsed = cut.withColumn("start", start).select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Date").alias("captured"),
        "record_type",
        field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.when(F.col("record_type") == "response", F.expr("substring(block, start + 4)")).alias("payload"),
        stated.alias("payload_bytes"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        "file",
        (F.octet_length("block") == F.col("length")).alias("whole"),
    )
    same = F.when(F.col("payload").isNull(), True).otherwise((F.octet_length("payload") == F.col("payload_bytes")) & (digest(F.col("payload")) == F.col("payload_digest")))
    sound = F.coalesce(F.col("whole") & same, F.lit(False))
    checked = F.when(sound, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("broken WARC record in "), "file")).cast("string"))
    return parsed.withColumn("record_type", checked).drop("whole")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-cased name, block) of each record of a WARC file, which may be compressed; by Content-Length."""
    file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := file.readline():
        if not line.strip():
            continue  # between records
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        name = ""
        while (line := file.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:  # a folded line
                fields[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        length = int(fields["content-length"])
        block = file.read(length)
        if len(block) < length:
            raise ValueError("a WARC record ends early")
        yield fields, block


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, type, id, url, captured, payload_digest, refers_to, block) of the records of any archives below path, .gz too.

    A file is read whole by one task, so it must fit in a worker's memory, as files of the usual gigabyte do; block is binary.
    """
    names = ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-refers-to")
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), *[(n, pa.string()) for n in ("type", "id", "url", "captured", "payload_digest", "refers_to")], ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held: list = []
                size = 0
                for n, (fields, block) in enumerate(parse(data.as_py())):
                    held.append((file, n, *[fields.get(k) for k in names], block))
                    size += len(block)
                    if size > 8 << 20:
                        yield _batch(held, schema)
                        held, size = [], 0
                if held:
                    yield _batch(held, schema)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "content")
    return files.mapInArrow(run, "file string, place long, type string, id string, url string, captured string, payload_digest string, refers_to string, block binary")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next winner takes one path to the top."""

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.losers = [-1] * k
        for i in range(k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node:
            if self.losers[node] < 0:  # the first to come waits for the other
                self.losers[node], winner = winner, -1
                break
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        if winner >= 0:
            self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[top := self.losers[0]] is not None:
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self._replay(top)


def merge_index(captures: DataFrame, keys: tuple[str, ...] = ("urlkey", "captured", "page_id"), range_rows: int = RANGE_ROWS) -> DataFrame:
    """captures in the order of keys (nulls first): rows within each part and parts one after the other."""
    runs = captures.sortWithinPartitions(*keys).withColumn("__run", F.spark_partition_id())
    runs = write_out(runs, "capture-runs")
    names, schema = runs.columns, captures.schema
    at, run_at = [names.index(k) for k in keys], names.index("__run")
    arrow = pa.schema([(f.name, pa.int64() if f.dataType.simpleString() == "bigint" else pa.string()) for f in schema])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[int, list] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                by_run.setdefault(row[run_at], []).append((tuple((row[i] is not None, row[i]) for i in at), row))
        for rows in by_run.values():  # a run's rows come from one task in its order; what comes otherwise is sorted
            if any(b[0] < a[0] for a, b in pairwise(rows)):
                rows.sort(key=lambda x: x[0])
        order = LoserTree([iter([(key, n, row) for n, (key, row) in enumerate(rows)]) for rows in by_run.values()])
        held: list = []
        for _, _, row in order:
            held.append(row)
            if len(held) == 4096:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs.count() // range_rows)
    return runs.repartitionByRange(parts, *keys).mapInArrow(work, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)


def captures(pages: DataFrame) -> DataFrame:
    """Writes pages to an archive in the shared folder, reads it back, and returns its captures in global order."""
    path = shared_path(pages.sparkSession, "warc")
    found = read(pages.sparkSession, path, write(pages, path))
    return merge_index(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", url_key(F.col("url")).alias("urlkey"), "captured"))
