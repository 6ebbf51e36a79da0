"""Written intermediates that cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from spark.checkpoint.dir.

    Only a local[...] session without that setting gets a folder of its own;
    on a cluster the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="gneiss-")
        atexit.register(shutil.rmtree, path, True)
        _LOCAL[app] = f"file://{path}"
    return _LOCAL[app]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate; a missing one is no error."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one run below the shared folder.

    keep() writes a DataFrame and reads it back, so that what follows neither
    recomputes nor depends on shuffle files of lost executors. free() deletes
    tables that nothing reads any more; what is left goes when the driver ends,
    as results may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gneiss-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def folder(self) -> str:
        """The folder, made, and deleted when the driver's JVM ends."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        return self.root

    def keep(self, df: DataFrame) -> DataFrame:
        if not self.n:
            self.folder()
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def free(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if (path := self.paths.pop(id(df), None)) is not None:
                drop(self.spark, path)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished rounds now."""
    spark._jvm.System.gc()
