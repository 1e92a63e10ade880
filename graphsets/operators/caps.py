"""Random caps on example rows, exact and repeatable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.functions.draws import draw
from graphsets.operators.ranking import FEW, joined_on, lowest, lowest_thinned
from graphsets.operators.saturation import saturation_points
from graphsets.session import BROADCAST_ROWS, durable, small_side

BIN = ["graph_idx", "component_id", "probability_bin"]
CONDITION = ["graph_idx", "query_entity", "observed_entities", "observed_values"]


def _check(cap: int | None) -> None:
    if cap is not None and cap < 0:
        raise ValueError(f"a cap must not be negative, got {cap}")


def cap_by_key(df: DataFrame, cap: int | None, keys: list, row_key: str, seed: int) -> DataFrame:
    """At most ``cap`` random rows per key; keys are names or Columns, null is a key too."""
    _check(cap)
    if cap is None:
        return df
    names = [f"_key{i}" for i in range(len(keys))]
    tagged = df
    for name, key in zip(names, keys):
        value = (F.col(key) if isinstance(key, str) else key).cast("string")
        tagged = tagged.withColumn(name, F.coalesce(F.concat(F.lit("="), value), F.lit("null")))
    tagged = tagged.withColumn("_draw", draw(seed, "cap_key", row_key))
    sizes = durable(tagged.groupBy(*names).agg(F.count(F.lit(1)).alias("_size")))
    if cap > FEW or sizes.count() > BROADCAST_ROWS:
        return lowest(tagged, names, "_draw", [row_key], cap).drop("_draw", *names)
    sized = joined_on(tagged, F.broadcast(sizes), names)
    return lowest_thinned(sized, names, "_draw", [row_key], cap, "_size").drop("_draw", "_size", *names)


def conditional_probability(rows: DataFrame, near: bool = False) -> DataFrame:
    """Counts and P(answer | observed values) per condition and answer, over train rows.

    Rows are counted before the shuffle. The window that adds the denominators
    holds one row per answer of a condition (true and false). If all graphs are small
    (``near``), rows are dealt by graph, once for all.
    """
    rows = rows.repartition("graph_idx") if near else rows
    counts = (
        rows.filter(F.col("split") == "train")
        .groupBy(*CONDITION, "answer")
        .agg(F.count(F.lit(1)).alias("value_count"))
    )
    return counts.withColumn(
        "condition_count", F.sum("value_count").over(Window.partitionBy(*CONDITION))
    ).withColumn("probability", F.col("value_count") / F.col("condition_count"))


def probability_bins(rows: DataFrame, near: bool = False) -> DataFrame:
    """Add ``probability_bin``: "0".."9", or "unobserved" without train rows.

    All wordings of an observation share its bin, so this may run before they
    are fanned out. One join; a condition has as many map entries as answers
    (true and false). If all graphs are small (``near``), rows are dealt by graph and counted in one sort of it.
    """
    if near:
        trained = F.count_if(F.col("split") == "train")
        counted = (
            rows.repartition("graph_idx")
            .withColumn("_value", trained.over(Window.partitionBy(*CONDITION, "answer")))
            .withColumn("_all", trained.over(Window.partitionBy(*CONDITION)))
        )
        known = reduce(Column.__and__, [F.col(name).isNotNull() for name in CONDITION], F.col("_all") > 0)
        decile = F.least(F.floor(F.col("_value") / F.col("_all") * 10), F.lit(9))
        binned = F.when(known, decile.cast("string")).otherwise("unobserved")
        return counted.withColumn("probability_bin", binned).drop("_value", "_all")
    seen = conditional_probability(rows).groupBy(*CONDITION).agg(
        F.max("condition_count").alias("_all"),
        F.map_from_entries(F.collect_list(F.struct("answer", "value_count"))).alias("_by_answer"),
    )
    value = F.coalesce(F.try_element_at("_by_answer", F.col("answer")), F.lit(0))
    decile = F.least(F.floor(value / F.col("_all") * 10), F.lit(9))
    return (
        rows.join(seen, CONDITION, "left")
        .withColumn(
            "probability_bin",
            F.when(F.col("_all").isNull(), "unobserved").otherwise(decile.cast("string")),
        )
        .drop("_all", "_by_answer")
    )


def with_bin_rows(rows: DataFrame) -> DataFrame:
    """Add ``bin_rows``, the rows of (graph, component, decile). Binned rows of small graphs, which are still dealt by graph."""
    return rows.withColumn("bin_rows", F.count(F.lit(1)).over(Window.partitionBy(*BIN)))


def cap_component_bin(rows: DataFrame, cap: int | None, row_key: str, seed: int) -> DataFrame:
    """At most ``cap`` train rows per (graph, component, decile); other rows pass.

    A null component is a component, and rows without a split are not train rows.

    Deciles come from the rows before the cap, unless ``rows`` already holds
    ``probability_bin``. Column component_id is the query entity's component. Where ``rows`` holds
    ``bin_rows``, about how many rows share the row's graph, component and decile, few rows are sorted.
    """
    _check(cap)
    if cap is None:
        return rows
    binned = rows if "probability_bin" in rows.columns else durable(probability_bins(rows))
    tagged = binned.withColumn("_draw", draw(seed, "cap_bin", row_key))
    trained = tagged.filter(F.col("split").eqNullSafe("train"))
    if "bin_rows" in rows.columns and cap <= FEW:
        kept = lowest_thinned(trained, BIN, "_draw", [row_key], cap, "bin_rows")
    else:
        kept = lowest(trained, BIN, "_draw", [row_key], cap)
    passed = tagged.filter(~F.col("split").eqNullSafe("train"))
    return kept.unionByName(passed).select(*rows.columns)


def cap_multilabel(
    df: DataFrame, cap: int | None, row_key: str, seed: int, split: str = "split", labels: str = "inference_types",
    primary: str = "primary_inference_type",
) -> DataFrame:
    """Keep a row, in random order, only while every label it carries is below ``cap`` in its split.

    ``labels`` holds the row's labels; where it is null or empty, ``primary`` is the one
    label. ``row_key`` must name each row once. Rows without any label pass. Equal to a one-pass greedy scan,
    but only the saturation points are computed, from counts; the rows are then
    filtered in one pass.
    """
    _check(cap)
    if cap is None:
        return df
    if cap == 0:
        return df.limit(0)
    named = F.filter(labels, lambda name: name.isNotNull())
    alone = F.array_compact(F.array(primary)) if primary in df.columns else F.array().cast("array<string>")
    carried = F.when(F.size(named) > 0, F.array_distinct(named)).otherwise(alone)
    tagged = (
        df.withColumn("_draw", draw(seed, "cap_labels", row_key))
        .withColumn("_labels", carried)
        .withColumn("_split", F.coalesce(F.concat(F.lit("="), split), F.lit("null")))
    )
    points = saturation_points(tagged, cap, "_split", "_labels", "_draw", row_key)
    # One row per split, holding a map over its labels.
    limits = small_side(
        points.groupBy(F.col("split").alias("_split")).agg(
            F.map_from_entries(F.collect_list(F.struct("label", "at"))).alias("_limits")
        )
    )
    place = F.struct(F.col("_draw").alias("d"), F.col(row_key).cast("string").alias("k"))
    inside = F.forall(
        "_labels",
        lambda name: F.coalesce(place <= F.try_element_at(F.col("_limits"), name), F.lit(True)),
    )
    return tagged.join(limits, "_split", "left").filter(inside).select(*df.columns)
