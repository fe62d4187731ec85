"""Tables from files and values, and results to files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import common

FORMATS = ("parquet", "json", "csv", "text", "orc")


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A table from files; the scan is Spark's, so filters and columns reach it."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind!r}")
    return spark.read.format(kind).options(**options).load(path)


def json_text(spark: SparkSession, text: str | bytes) -> DataFrame:
    """One JSON document as a row whose columns are its fields, in their order.
    Values that mix kinds become variants; text that is no JSON fails here."""
    value = json.loads(text)
    if not isinstance(value, dict):
        value = {"value": value}
    schema = T.StructType([T.StructField(k, settled(shape(v))) for k, v in value.items() if v is not None])
    got = spark.createDataFrame([(json.dumps(value),)], "t string").select(F.from_json("t", schema).alias("d"))
    return got.select(*[F.lit(None).alias(k) if v is None else F.col("d")[k].alias(k) for k, v in value.items()])


def shape(v) -> T.DataType:
    """The type that holds a JSON value."""
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, T.NullType() if x is None else shape(x)) for k, x in v.items()])
    if isinstance(v, list):
        types = [shape(x) for x in v if x is not None]
        return T.ArrayType(common(types))
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.LongType() if -(1 << 63) <= v < 1 << 63 else T.DoubleType()
    return T.DoubleType() if isinstance(v, float) else T.StringType()


def settled(t: T.DataType) -> T.DataType:
    """A type without unknown parts; those become text."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(settled(t.elementType))
    return T.StringType() if isinstance(t, T.NullType) else t


def json_lines(spark: SparkSession, path: str, variant: bool = False) -> DataFrame:
    """A table from a JSON object a line, by an inferred schema or, with
    ``variant``, as one variant column ``value``."""
    if not variant:
        return spark.read.json(path)
    return spark.read.text(path).select(F.parse_json("value").alias("value"))


def documents(df: DataFrame, column: str) -> DataFrame:
    """A column of JSON text as variants, in its place; bad text fails."""
    return df.withColumn(column, F.parse_json(column))


def rows(spark: SparkSession, values: list[dict]) -> DataFrame:
    """A table from Python dicts."""
    return spark.createDataFrame(values)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:
    """A result to files."""
    out = df.write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).format(kind).save(path)
