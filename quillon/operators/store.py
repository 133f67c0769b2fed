"""Mutations: ordered batches folded into states, with reports; and a versioned store of Parquet snapshots and a log.

A store is a folder with `manifest.json` and, for each version, `v=<n>/` of active rows; `log/seq=<n>/` has the batches since and
`batches/` a file for each batch id.  One driver writes; readers open a version and keep it.  All files go through Hadoop's file
systems, so a store can be wherever Spark reads and writes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MAX_DIMENSIONS, Metric, Space, check_name
from ..errors import EngineError, invalid
from ..files import Files

MUTATION = "seq long, ordinal int, op string, id long"


def fold(mutations: DataFrame, base: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """The state after mutations (seq, ordinal, op, id, columns) on base (id, columns): of each id its last operation counts.

    Both are reduced by id in one shuffle; rows whose last operation is a delete go.  Any other op, null too, is an error.
    """
    names = [c for c in mutations.columns if c not in ("seq", "ordinal", "op")]
    rows = mutations
    if base is not None:
        rows = base.select(F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("ordinal"), F.lit("put").alias("op"), *names).unionByName(mutations.select("seq", "ordinal", "op", *names))
    rows = rows.withColumn("op", F.when(F.coalesce(F.col("op").isin("put", "delete"), F.lit(False)), F.col("op")).otherwise(F.raise_error(F.lit("a mutation is a put or a delete")).cast("string")))
    last = rows.groupBy(id_col).agg(F.max_by(F.struct("op", *[c for c in names if c != id_col]), F.struct("seq", "ordinal")).alias("r"))
    return last.where(F.col("r.op") == "put").select(*[F.col(id_col) if c == id_col else F.col(f"r.{c}").alias(c) for c in names])


def batch_report(mutations: DataFrame, present: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(seq, inserted, updated, deleted, absent): what each batch did, later operations seeing earlier ones."""
    order = Window.partitionBy(id_col).orderBy("seq", "ordinal")
    rows = mutations.select("seq", "ordinal", "op", id_col)
    if present is not None:
        rows = rows.join(present.select(id_col).distinct().withColumn("__there", F.lit(True)), id_col, "left")
    else:
        rows = rows.withColumn("__there", F.lit(None).cast("boolean"))
    there = F.coalesce(F.lag("op").over(order) == "put", F.coalesce("__there", F.lit(False)))
    put = F.col("op") == "put"
    return rows.withColumn("there", there).groupBy("seq").agg(
        F.count_if(put & ~F.col("there")).alias("inserted"), F.count_if(put & F.col("there")).alias("updated"), F.count_if(~put & F.col("there")).alias("deleted"), F.count_if(~put & ~F.col("there")).alias("absent")
    )


def stats(df: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: rows, coordinate bytes, least and largest dimension."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(vector).cast("long") * 4), F.lit(0).cast("long")).alias("vector_bytes"), F.min(F.size(vector)).alias("min_dims"), F.max(F.size(vector)).alias("max_dims"))


def doctor(df: DataFrame, space: Space | None = None, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """One row of counts of what is wrong: repeated or missing ids, wrong dimensions, values not finite, zero vectors."""
    odd = F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    wide = F.size(vector) != F.lit(space.dimensions) if space else (F.size(vector) < 1) | (F.size(vector) > MAX_DIMENSIONS)
    zero = F.forall(vector, lambda x: x == 0) if space and space.metric is Metric.COSINE else F.lit(False)
    once = df.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(odd).alias("odd"), F.count_if(F.coalesce(wide, F.lit(True))).alias("wide"), F.count_if(zero).alias("zero"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return once.agg(
        total("n").alias("rows"), total(F.col("n") - 1).alias("repeated_ids"), total(F.when(F.col(id_col).isNull(), F.col("n")).otherwise(0)).alias("null_ids"),
        total("odd").alias("not_finite"), total("wide").alias("wrong_dimensions"), total("zero").alias("zero_vectors"),
    )


@dataclass
class Policy:
    """When to compact: so many dead rows, and that share of all."""

    dead_rows: int = 128
    dead_share: float = 0.2
    log_bytes: int = 64 << 20

    def action(self, physical: int, active: int, log_bytes: int) -> str:
        dead = physical - active
        if dead >= self.dead_rows and dead >= self.dead_share * physical:
            return "compact"
        return "checkpoint" if log_bytes >= self.log_bytes else "none"


class Store:
    """A collection below a path that driver and executors share."""

    #: A lock that its writer hasn't renewed for so many seconds is taken over: that driver is gone.
    STALE = 3600

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        if not self.files.exists("manifest.json"):
            raise EngineError("NotFound", path)
        self.manifest = self.files.read("manifest.json")
        self.space = Space(self.manifest["model"], self.manifest["dimensions"], Metric(self.manifest["metric"]))

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, space: Space, schema: str) -> Store:
        path = f"{root}/{check_name(name)}"
        files = Files(spark, path)
        if files.exists():
            raise EngineError("AlreadyExists", path)
        spark.createDataFrame([], schema).write.parquet(f"{path}/v=0")
        made = {"name": name, "model": space.model, "dimensions": space.dimensions, "metric": space.metric.value, "schema": schema, "version": 0, "sequence": 0, "base": 0}
        if not files.create("manifest.json", made):
            raise EngineError("AlreadyExists", path)
        return cls(spark, path)

    @contextmanager
    def _locked(self) -> Iterator[None]:
        if self.files.exists("lock") and self.files.age("lock") > self.STALE:
            self.files.delete("lock")
        if not self.files.create("lock", {"by": uuid.uuid4().hex}):
            raise EngineError("Locked", self.path)
        try:
            self.manifest = self.files.read("manifest.json")
            yield
        finally:
            self.files.delete("lock")

    def _commit(self, **changes) -> None:
        self.manifest |= changes
        self.files.replace("manifest.json", self.manifest)

    def _version(self) -> DataFrame:
        return self.spark.read.schema(self.manifest["schema"]).parquet(f"{self.path}/v={self.manifest['version']}")

    def state(self) -> DataFrame:
        """Active rows: the version's, and what committed batches made of them.  Fails if a batch of the log is missing."""
        m = self.manifest
        seqs = range(m["base"] + 1, m["sequence"] + 1)
        if not seqs:
            return self._version()
        there = set(self.files.names("log"))
        if missing := [s for s in seqs if f"seq={s}" not in there]:
            raise EngineError("Corrupt", f"the log has no batch {missing[0]}")
        log = self.spark.read.schema(f"{MUTATION}, {', '.join(x for x in _fields(m['schema']) if not x.startswith('id '))}").parquet(*[f"{self.path}/log/seq={s}" for s in seqs])
        return fold(log, self._version())

    def write_batch(self, ops: DataFrame, if_sequence: int | None = None, batch_id: str | None = None, space: Space | None = None) -> dict:
        """Applies ops (ordinal, op, id, columns) as one batch; nothing is written where it has no effect.

        if_sequence: fails if the store has moved on.  batch_id: a batch that was ever applied before is not applied again.
        """
        if space is not None:
            self.space.check(space)
        with self._locked():
            m = self.manifest
            if if_sequence is not None and if_sequence != m["sequence"]:
                raise EngineError("Conflict", f"sequence is {m['sequence']}, not {if_sequence}")
            nothing = {"sequence": m["sequence"], "inserted": 0, "updated": 0, "deleted": 0, "absent": 0}
            mark = f"batches/{hashlib.sha256(batch_id.encode()).hexdigest()}" if batch_id is not None else None
            if mark and self.files.exists(mark) and self.files.read(mark)["sequence"] <= m["sequence"]:
                return nothing
            known = F.coalesce(F.col("op").isin("put", "delete"), F.lit(False))
            whole = F.coalesce((F.size("vector") == self.space.dimensions) & ~F.exists("vector", lambda x: x.isNull()), F.lit(False))
            bad = ops.where(~known | F.col("id").isNull() | ((F.col("op") == "put") & ~whole))
            if bad.limit(1).count():
                raise invalid("a batch has puts with all coordinates, and deletes")
            seq = m["sequence"] + 1
            path = f"{self.path}/log/seq={seq}"
            ops.withColumn("seq", F.lit(seq).cast("long")).select("seq", *[c for c in ops.columns]).write.mode("overwrite").parquet(path)
            ops = self.spark.read.parquet(path).withColumn("seq", F.lit(seq).cast("long"))
            row = batch_report(ops, self.state()).first()
            report = nothing if row is None else {k: row[k] for k in ("inserted", "updated", "deleted", "absent")}
            if not any(report[k] for k in ("inserted", "updated", "deleted")):
                self.files.delete(f"log/seq={seq}")
                return nothing | {"absent": report["absent"]}
            if mark:  # it counts once the sequence does
                self.files.delete(mark)
                self.files.create(mark, {"sequence": seq})
            self._commit(sequence=seq)
            return report | {"sequence": seq}

    def checkpoint(self) -> int:
        """Folds the log into a new version, which readers see from their next open on; returns how many rows of the last one it dropped."""
        with self._locked():
            m = self.manifest
            before, new = self._version(), m["version"] + 1
            self.state().orderBy("id").write.mode("overwrite").parquet(f"{self.path}/v={new}")
            gone = before.join(self.spark.read.parquet(f"{self.path}/v={new}").select("id"), "id", "left_anti").count()
            self._commit(version=new, base=m["sequence"])
            return gone

    def compact(self) -> int:
        """A checkpoint; then versions and batches that it replaces go.  Returns bytes freed; readers of old versions must be done."""
        self.checkpoint()
        with self._locked():
            m, freed = self.manifest, 0
            old = [f"v={n.removeprefix('v=')}" for n in self.files.names() if n.startswith("v=") and n != f"v={m['version']}"]
            old += [f"log/{n}" for n in self.files.names("log") if int(n.removeprefix("seq=")) <= m["base"]]
            for name in old:
                freed += self.files.size(name)
                self.files.delete(name)
            return freed

    def maintain(self, policy: Policy = Policy()) -> str:
        """Does what the policy asks for now: `compact`, `checkpoint` or `none`."""
        rows, active = self._version(), self.state()
        kept = rows.join(active.select("id"), "id", "left_semi").count()
        physical = rows.count()
        action = policy.action(physical, kept, self.files.size("log"))
        if action != "none":
            getattr(self, action)()
        return action

    def export(self, path: str) -> None:
        """The active rows as a table of their own; fails if it is there."""
        if Files(self.spark, path).exists():
            raise EngineError("AlreadyExists", path)
        self.state().write.mode("errorifexists").parquet(path)

    def backup(self, root: str, name: str) -> Store:
        """A store of its own with the active rows, which can be opened and written."""
        copy = Store.create(self.spark, root, name, self.space, self.manifest["schema"])
        copy.import_rows(self.state())
        return copy

    def import_rows(self, rows: DataFrame) -> int:
        """Fills an empty store with rows of its schema, as version 1; returns how many.  Ids must not repeat."""
        with self._locked():
            if self.manifest["sequence"] or self.manifest["version"]:
                raise EngineError("Conflict", "rows are imported into an empty store")
            names = [x.split()[0] for x in _fields(self.manifest["schema"])]
            path = f"{self.path}/v=1"
            rows.select(*names).orderBy("id").write.mode("overwrite").parquet(path)
            bad = doctor(self.spark.read.parquet(path), self.space).first().asDict()
            total = bad.pop("rows")
            if any(bad.values()):
                self.files.delete("v=1")
                raise invalid(f"the rows can't be a store: {bad}")
            self._commit(version=1, sequence=1, base=1)
            return total


def _fields(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(schema)]


def publish(df: DataFrame, root: str, sequence: int, id_col: str = "id") -> int:
    """Writes df as the next generation below root and points CURRENT at it; sequences may not go back, ids not repeat or be null.

    A generation that fails goes again; readers never see it.
    """
    spark, files = df.sparkSession, Files(df.sparkSession, root)
    current = read_current(spark, root)
    if current and sequence < current["sequence"]:
        raise invalid("the sequence goes back")
    number = (current["generation"] if current else 0) + 1
    path = f"{root}/gen={number}"
    df.orderBy(id_col).write.mode("overwrite").parquet(path)
    n, ids = spark.read.parquet(path).agg(F.count("*"), F.count_distinct(id_col)).first()
    if n != ids:
        files.delete(f"gen={number}")
        raise invalid("an id repeats or is null")
    files.replace("CURRENT", {"generation": number, "sequence": sequence, "rows": n, "bytes": files.size(f"gen={number}")})
    return number


def read_current(spark: SparkSession, root: str) -> dict | None:
    files = Files(spark, root)
    return files.read("CURRENT") if files.exists("CURRENT") else None


def open_generation(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame:
    """A pinned generation: later ones don't change what this reads.  The current one must have the rows it was published with."""
    current = read_current(spark, root)
    if current is None or (generation and not Files(spark, root).exists(f"gen={generation}")):
        raise EngineError("NotFound", root)
    df = spark.read.parquet(f"{root}/gen={generation or current['generation']}")
    if not generation and df.count() != current["rows"]:  # from the files' footers
        raise EngineError("Corrupt", f"{root} has not the rows of its CURRENT")
    return df


def pin(spark: SparkSession, root: str, generation: int) -> str:
    """Keeps a generation from collect_generations until unpin(name)."""
    name = f"pins/{generation}.{uuid.uuid4().hex}"
    Files(spark, root).create(name, {"generation": generation})
    return name


def unpin(spark: SparkSession, root: str, name: str) -> None:
    Files(spark, root).delete(name)


def collect_generations(spark: SparkSession, root: str, keep: int = 1) -> list[int]:
    """Deletes all generations but the last `keep`, the current one and those that are pinned; returns their numbers."""
    files, current = Files(spark, root), read_current(spark, root)
    if current is None:
        return []
    if keep < 1:
        raise invalid("keep must be at least 1")
    numbers = sorted(int(n.removeprefix("gen=")) for n in files.names() if n.startswith("gen="))
    held = {int(n.split(".")[0]) for n in files.names("pins")} | {current["generation"], *numbers[-keep:]}
    gone = [n for n in numbers if n not in held]
    for n in gone:
        files.delete(f"gen={n}")
    return gone


def generations(spark: SparkSession, root: str) -> DataFrame:
    """(generation, bytes, current, pins) of what is there."""
    files, current = Files(spark, root), read_current(spark, root) or {"generation": None}
    numbers = sorted(int(n.removeprefix("gen=")) for n in files.names() if n.startswith("gen="))
    pins = [int(n.split(".")[0]) for n in files.names("pins")]
    rows = [(n, files.size(f"gen={n}"), n == current["generation"], pins.count(n)) for n in numbers]
    return spark.createDataFrame(rows, "generation long, bytes long, current boolean, pins long")
