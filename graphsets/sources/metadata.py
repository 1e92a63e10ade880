"""The metadata record of a data set.

Counts and parameters are one JSON object. The split of every entity grows with
the data, so it is a table of JSON lines beside that object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsets.schema import METADATA_SCHEMA


def metadata_record(rows: DataFrame, parameters: dict) -> DataFrame:
    """One row: parameters, rows per split and rows per kind (maps over a few labels)."""
    counts = rows.groupingSets([["split"], ["kind"]], "split", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("kind").alias("_per_split")
    )

    def counted(key, wanted):
        entry = F.when(F.col("_per_split") == wanted, F.struct(key, "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"{key}_counts")

    totals = counts.agg(counted("split", 1), counted("kind", 0))
    fields = []
    for field in METADATA_SCHEMA.fields:
        if field.name in totals.columns:
            fields.append(F.col(field.name))
        else:
            fields.append(F.lit(parameters.get(field.name)).cast(field.dataType).alias(field.name))
    return totals.select(*fields)


def write_metadata(record: DataFrame, splits: DataFrame, path: str) -> None:
    base = path.rstrip("/")
    names = sorted(record.columns)
    record.select(*names).coalesce(1).write.option("ignoreNullFields", "false").json(f"{base}/metadata")
    splits.select("entity", "graph_idx", "split").write.json(f"{base}/explanation_split_by_entity")


def read_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The metadata record and the table of entity splits."""
    base = path.rstrip("/")
    record = spark.read.schema(METADATA_SCHEMA).json(f"{base}/metadata")
    splits = spark.read.schema("entity string, graph_idx bigint, split string").json(
        f"{base}/explanation_split_by_entity"
    )
    return record, splits
