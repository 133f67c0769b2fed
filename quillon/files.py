"""Small files and folders on whatever file system Spark is set up for, and the folder for tables that queries keep."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Files:
    """Hadoop's view of the paths below a root; driver and executors see the same files."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength() if self.exists(name) else 0

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        return (self._jvm.System.currentTimeMillis() - self._fs.getFileStatus(self._at(name)).getModificationTime()) / 1000

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, content: dict) -> bool:
        """Writes a new file; False if it is there."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Exception as error:
            if self.exists(name):
                return False
            raise error
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        return True

    def replace(self, name: str, content: dict) -> None:
        """Puts a file in another's place by renaming; read() never sees half of it, but for an instant it may see none."""
        new = f"{name}.{uuid.uuid4().hex}"
        self.create(new, content)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._fs.getConf())
        kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(kinds.OVERWRITE.getClass(), 1)
        options[0] = kinds.OVERWRITE
        context.rename(self._at(new), self._at(name), options)


def kept_dir(spark: SparkSession) -> str:
    """The folder for tables that queries keep: spark.checkpoint.dir, else the warehouse; both are shared."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of its own and read back."""
    path = f"{kept_dir(df.sparkSession)}/quillon-kept/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
