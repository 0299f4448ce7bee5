"""Tables written between the rounds of an iterative operator.

Lineage is cut by writing a table to the folder that all executors share (``spark.checkpoint.dir``), so a lost
executor loses nothing.  The folder is read from the session.  Where none is set, a local session gets a temporary one
and any other is refused: a folder of one machine would hold only what that machine's tasks have written.

A table that a later round replaces is deleted at once.  The last ones are read lazily by whoever has the result, so
they go when the caller says so (``sweep``) or when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the operators that have run in each application.
_roots: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor sees; only a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
        if folder is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            folder = tempfile.mkdtemp(prefix="memloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _path(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Delete the tables of all operators that have run in this application; results read before stay as they are."""
    for root in _roots.pop(spark.sparkContext.applicationId, []):
        delete(spark, root)


class Scratch:
    """Writes intermediate tables and deletes those that a later round has replaced."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[str, str] = {}
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        target, system = _path(spark, self.root)
        system.deleteOnExit(target)

    def write(self, df: DataFrame, key: str, keep: bool = False) -> DataFrame:
        """Materialise ``df`` under ``key``; an older table of the same key is deleted unless ``keep``."""
        self.count += 1
        path = f"{self.root}/{key}-{self.count}"
        df.write.mode("overwrite").parquet(path)
        old = self.paths.get(key)
        self.paths[key] = path
        if old and not keep:
            delete(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        """Delete tables that neither a later step nor the result reads."""
        for key in keys:
            path = self.paths.pop(key, None)
            if path:
                delete(self.spark, path)
