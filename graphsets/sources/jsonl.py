"""Example rows as JSON lines, and result files."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsets.functions.jsonsafe import json_ready
from graphsets.schema import EXAMPLE_COLUMNS, EXAMPLE_SCHEMA, SPLITS
from graphsets.session import files_open


def split_folder(path: str, split: str) -> str:
    return f"{path.rstrip('/')}/part={split}"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines per split, keys sorted, nulls kept; the files are compressed.

    All splits are written in one pass over the rows, each task with a file open for each
    split, so rows are not sorted by their split first; a split without rows gets an empty folder.
    """
    columns = sorted(EXAMPLE_COLUMNS)
    spark = rows.sparkSession
    options = {"ignoreNullFields": "false", "zlib.compress.level": "TWO"}
    with files_open(spark, len(SPLITS) + 1):
        rows.select(*columns, F.col("split").alias("part")).write.partitionBy("part").options(**options).json(path, compression="gzip")
    for split in SPLITS:
        folder = split_folder(path, split)
        if not _exists(spark, folder):
            spark.createDataFrame([], EXAMPLE_SCHEMA).select(*columns).write.json(folder)


def scan_examples(spark: SparkSession, path: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Example rows of some splits, with the declared record layout."""
    return spark.read.schema(EXAMPLE_SCHEMA).json([split_folder(path, s) for s in splits])


def write_results(records: DataFrame, path: str, sets: Collection[str] = ()) -> None:
    """Scored records, nested as they are, as JSON lines with nulls kept.

    NaN and infinities become null, map keys strings and the arrays at the paths ``sets``
    sorted sets, at every depth.
    """
    json_ready(records, sets).write.option("ignoreNullFields", "false").json(path)


def scan_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Result records with the declared layout; ``schema`` may be that of the records as they were written."""
    return spark.read.schema(_with_text_keys(schema)).json(path)


def _with_text_keys(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _with_text_keys(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with_text_keys(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _with_text_keys(kind.valueType))
    return kind
