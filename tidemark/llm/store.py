"""Shared scratch tables: how these operators cut lineage so that lost executors cost only the running stage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_roots: list[str] = []


def clean(spark: SparkSession) -> None:
    """Deletes the scratch tables of this session's finished calls; call it once their results are written."""
    while _roots:
        _delete(spark, _roots.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operator call, written as Parquet to the shared folder.

    ``keep`` writes and rereads a table (its lineage is then a scan of shared files), ``drop`` deletes one that no
    later plan reads. What is left goes by ``clean``, or when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _roots.append(self.root)
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            _delete(self.spark, path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def trim() -> None:
    """Gives freed memory of this process back to the system; other stages' code shares the executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy(run):
    """A function over batches that trims its process when its task ends; Spark uses the process again."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
