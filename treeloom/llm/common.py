"""Helpers shared by the operators: shared-folder tables and column checks."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table that may be sent to every executor.
BROADCAST = 16 << 20
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where it is unset and one machine is all there is (a local master, as
    in tests) a temporary folder is made and registered with the context; on a
    cluster without it this raises a RuntimeError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="treeloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() frees one."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def lean(run):
    """Work of a task that gives back at its end what Arrow and malloc keep for
    reuse: the worker lives on beside others."""
    def leaning(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()

    return leaning


def text_of(name: str):
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_bytes(df: DataFrame) -> int:
    """About how many bytes a table's rows hold in memory: 16 a row and 8 a
    value, and what texts, bytes and arrays are long."""
    def width(x, t):
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(x), F.lit(0)) + 16
        if isinstance(t, T.StructType):
            return sum((width(x.getField(f.name), f.dataType) for f in t.fields), F.lit(8))
        if isinstance(t, T.ArrayType):
            return F.coalesce(F.size(x), F.lit(0)) * 8 + 24
        return F.lit(8)

    return df.agg(F.sum(sum((width(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long"))).first()[0] or 0


def small(df: DataFrame) -> bool:
    """Whether the rows of a table written to the shared folder are few enough
    bytes to broadcast; beyond that the planner joins by a shuffle."""
    return held_bytes(df) <= BROADCAST
