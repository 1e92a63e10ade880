"""Running sums over a global order, with DataFrame operations only.

Rows are dealt into ranges of the order, each range is summed, the few range totals
are summed up, and only within one range are rows sorted together. A group that
holds most rows spans many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.llm.store import saved, shuffle_parts


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str | Column], group: list[str] | None = None) -> DataFrame:
    """Add, for each ``name: value`` of ``sums``, the sum of value over all rows before.

    ``order`` must be total up to rows that are alike. Group columns must not be null;
    sums start anew in each group. Values must be integers, so that sums are exact.
    """
    group = group or []
    values = {f"_{name}": value for name, value in sums.items()}
    ranged = saved(
        df.withColumns({k: F.col(v) if isinstance(v, str) else v for k, v in values.items()})
        .repartitionByRange(shuffle_parts(df), *group, *order)
        .withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    totals = ranged.groupBy("_part", *group).agg(*[F.sum(k).alias(f"{k}_all") for k in values])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *group, *[F.coalesce(F.sum(f"{k}_all").over(earlier), F.lit(0)).alias(f"{k}_before") for k in values]
    )
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(offsets, ["_part", *group])
    return placed.withColumns(
        {name: F.col(f"_{name}_before") + F.coalesce(F.sum(f"_{name}").over(inside), F.lit(0)) for name in sums}
    ).drop("_part", *values, *[f"{k}_before" for k in values])
