"""Steps written once as Parquet in the shared folder and read back.

A lost executor then costs a read of the written files, and later steps read
only the columns they need.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from graphsets.session import scratch_path

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    before = int(spark.conf.get(_BATCH))
    spark.conf.set(_BATCH, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, str(before))


def saved(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` as written below the folder that all executors share.

    With ``batch_rows``, no more rows than that pass between Spark and Python at a time, which
    bounds what both hold of wide rows.
    """
    path = scratch_path(df.sparkSession, name)
    if batch_rows is None:
        df.write.parquet(path)
    else:
        with _batches_of(df.sparkSession, batch_rows):
            df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
