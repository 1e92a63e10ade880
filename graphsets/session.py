"""Shared folder and lineage cuts.

Iterative operators write each round as a table, so a lost executor costs one
re-read and not a replay of all earlier rounds.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that is broadcast by hint; every such side is counted first.
BROADCAST_ROWS = 200_000


def workspace(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in a local session a part of the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application owns."""
    return f"{workspace(spark).rstrip('/')}/graphsets/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def end_run(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results must be written elsewhere before."""
    _delete(spark, run_folder(spark))


def _written(df: DataFrame, by: str | None) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "step")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns), path


def durable(df: DataFrame, by: str | None = None) -> DataFrame:
    """Compute ``df`` once, as Parquet in the shared folder; later reads prune columns.

    With ``by``, a column of few values, a filter on it reads only the files of its value.
    """
    return _written(df, by)[0]


class Rounds:
    """The tables of one loop, with this loop as their only owner.

    A round's tables are deleted once the next round is committed and reads them no more, so
    the loop holds two rounds at most. What was written before the last ``keep`` is gone
    at the end.
    """

    def __init__(self) -> None:
        self._paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """As ``durable``."""
        table, path = _written(df, by)
        self._paths.append((table, path))
        return table

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables of this loop but these, which must be committed and read none of the others."""
        stay = {id(t) for t in tables}
        for table, path in self._paths:
            if id(table) not in stay:
                _delete(table.sparkSession, path)
        self._paths = [(t, p) for t, p in self._paths if id(t) in stay]


_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def dealt_once(spark: SparkSession) -> Iterator[None]:
    """While open, rows that are dealt by some keys of a join stay where they are. What runs inside must have no hot ones."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)


def is_dealt_once(spark: SparkSession) -> bool:
    return spark.conf.get(_ALL_KEYS) == "false"


_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def files_open(spark: SparkSession, most: int) -> Iterator[None]:
    """While open, a task that writes into folders by a column keeps up to ``most`` files open and sorts rows only beyond that."""
    before = spark.conf.get(_OPEN_FILES)
    spark.conf.set(_OPEN_FILES, str(most))
    try:
        yield
    finally:
        spark.conf.set(_OPEN_FILES, before)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partition before a step whose output dwarfs its input.

    The count is ``spark.sql.shuffle.partitions`` and is not coalesced, as the
    input's few bytes say nothing about the output.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def dealt(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: moved by the keys and never sent to the driver for a broadcast.

    Spark would send it as long as its file or shuffle, which are packed, looks small.
    """
    return df.hint("merge")


def small_side(df: DataFrame) -> DataFrame:
    """Compute a join side once; broadcast it only if its counted size allows."""
    kept = durable(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else dealt(kept)
