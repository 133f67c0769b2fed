"""What the operators share: the shared folder, written tables that cut lineage, Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` parts at the same six bytes.
WORD_SPACE = " \t\n\x0b\x0c\r"
#: Lower-cases A-Z only.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
DICTIONARY_BYTES = 16 << 20
#: Share of the driver's largest heap from which it is cleaned before a table is written.
HEAP_SHARE = 0.4
_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []
#: What a Python worker keeps from one task to the next, and the work that it is for.
_kept: dict[str, object] = {}
_kept_for: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset (tests)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing before it.

    Dictionaries may be larger than usual: hashes of words and keys of rows repeat, and are long otherwise.
    """
    _breathe(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_quillon_path"] = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of write_out or keep_table that nothing will read again, and lets go the shuffle files of the jobs that made them.

    Spark deletes those when the driver's garbage is collected, which may be much later.
    """
    for df in tables:
        if path := df.__dict__.pop("_quillon_path", None):
            _delete(df.sparkSession, path)
            _written.remove((df.sparkSession, path))
        if table := df.__dict__.pop("_quillon_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            _tables.remove((df.sparkSession, table))
    if tables:
        let_go(tables[0].sparkSession)


def let_go(spark: SparkSession) -> None:
    """Collects the driver's garbage, and with it the shuffle files of jobs that are done."""
    gc.collect()
    spark._jvm.System.gc()


def _breathe(spark: SparkSession) -> None:
    """Has the driver's garbage collected where its heap has grown: jobs leave plans, generated classes and shuffle files behind."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        let_go(spark)


def keep_table(spark: SparkSession, table: str) -> DataFrame:
    """A written table, which goes when the driver ends, or by drop_written."""
    _tables.append((spark, table))
    out = spark.table(table)
    out.__dict__["_quillon_table"] = table
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, table in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:
            break
    for spark, path in reversed(_written):
        try:
            _delete(spark, path)
        except Exception:  # the session has gone, with it the cluster's folders
            return


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in rows and bytes, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def begin(work: str) -> None:
    """A worker's task of some work begins: what the worker kept for other work goes."""
    if _kept_for != [work]:
        _kept.clear()
        _kept_for[:] = [work]


def kept(name: str, make: Callable[[], object]) -> object:
    """What make gives, once for each worker until it begins other work."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str) -> DataFrame:
    """mapInArrow with Python lists: fn takes columns (strings as UTF-8 bytes) and returns columns."""
    spark = df.sparkSession
    bounded_batches(spark)
    out = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in spark.createDataFrame([], schema).schema])

    work = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(work)
        for batch in batches:
            cols = {}
            for name, col in zip(batch.schema.names, batch.columns, strict=True):
                if pa.types.is_string(col.type):
                    col = col.cast(pa.binary())
                elif pa.types.is_large_string(col.type):
                    col = col.cast(pa.large_binary())
                cols[name] = col.to_pylist()
            if not batch.num_rows:
                continue
            made = fn(cols)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    fixed = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.list_(_arrow(kind[6:-1])) if kind.startswith("array<") else fixed[kind]


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``, JVM-side; null text has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+"), "")).cast("long")


def quoted(name: str) -> str:
    """A column's name as a reference, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def row_of(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def hashable(df: DataFrame) -> list[Column]:
    """The columns of df in a form that hashes: those that hold maps as JSON."""
    return [F.to_json(F.col(quoted(f.name))) if "map<" in f.dataType.simpleString() or f.dataType.typeName() == "variant" else F.col(quoted(f.name)) for f in df.schema]
