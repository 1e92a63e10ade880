"""Exact-count train/val/test assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsets.functions.draws import draw
from graphsets.operators.ranking import draw_ranked
from graphsets.session import durable


def split_sizes(count: Column, val_ratio: float, test_ratio: float) -> tuple[Column, Column]:
    """(val, test) sizes of ``count`` items.

    Half-even rounded shares, at least one each from three items on if the
    ratio is positive. If they leave no training item, the larger share shrinks
    first (test on ties) until one is left; written here without a loop.
    """

    def share(ratio):
        size = F.bround(count * F.lit(float(ratio)), 0).cast("bigint")
        if ratio > 0:
            size = F.when(count >= 3, F.greatest(size, F.lit(1))).otherwise(size)
        return size

    val, test = share(val_ratio), share(test_ratio)
    room = F.greatest(count - 1, F.lit(0))
    excess = val + test - room
    half_down = F.floor(room / 2)
    half_up = room - half_down
    shrunk_test = F.when(test >= val, F.greatest(test - excess, half_down)).otherwise(
        room - F.greatest(val - excess, half_up)
    )
    fits = excess <= 0
    new_test = F.when(fits, test).otherwise(shrunk_test).cast("bigint")
    new_val = F.when(fits, val).otherwise(room - shrunk_test).cast("bigint")
    return new_val, new_test


def split_exact(
    items: DataFrame, keys: list[str], item: list[str], val_ratio: float, test_ratio: float, seed: int
) -> DataFrame:
    """Add ``split`` to distinct items: per group, exact sizes in draw order."""
    drawn = items.withColumn("_draw", draw(seed, "split", *keys, *item))
    ranked = draw_ranked(drawn, keys, "_draw", item, "_rank", "_n")
    val, test = split_sizes(F.col("_n"), val_ratio, test_ratio)
    name = (
        F.when(F.col("_rank") <= val, "val")
        .when(F.col("_rank") <= val + test, "test")
        .otherwise("train")
    )
    return ranked.withColumn("split", name).drop("_draw", "_rank", "_n")


def split_by_node(nodes: DataFrame, val_ratio: float, test_ratio: float, seed: int) -> DataFrame:
    return split_exact(nodes, ["graph_idx"], ["entity"], val_ratio, test_ratio, seed)


def split_by_graph(nodes: DataFrame, val_ratio: float, test_ratio: float, seed: int) -> DataFrame:
    graphs = split_exact(
        nodes.select("graph_idx").distinct(), [], ["graph_idx"], val_ratio, test_ratio, seed
    )
    return nodes.join(graphs, "graph_idx")


def entity_splits(
    nodes: DataFrame, scope: str, val_ratio: float, test_ratio: float, seed: int
) -> DataFrame:
    """(graph_idx, entity, split) for a held-out scope of ``nodes`` or ``graphs``."""
    scopes = {"nodes": split_by_node, "graphs": split_by_graph}
    if scope not in scopes:
        raise ValueError(f"held-out scope must be one of {sorted(scopes)}, got {scope!r}")
    return durable(
        scopes[scope](nodes.select("graph_idx", "entity"), val_ratio, test_ratio, seed)
    )


def strictest_split(*splits: Column) -> Column:
    """test before val before train; unknown (null) entities do not count."""
    mentioned = F.array(*splits)
    return (
        F.when(F.array_contains(F.array_compact(mentioned), "test"), "test")
        .when(F.array_contains(F.array_compact(mentioned), "val"), "val")
        .otherwise("train")
    )


def pair_split(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """Add the split of pairs (graph_idx, first, second) by the entities they mention."""
    one = splits.select("graph_idx", F.col("entity").alias("first"), F.col("split").alias("_s1"))
    two = splits.select("graph_idx", F.col("entity").alias("second"), F.col("split").alias("_s2"))
    return (
        pairs.join(one, ["graph_idx", "first"], "left")
        .join(two, ["graph_idx", "second"], "left")
        .withColumn("split", strictest_split(F.col("_s1"), F.col("_s2")))
        .drop("_s1", "_s2")
    )


def entity_split_counts(splits: DataFrame) -> DataFrame:
    """Entities per split, one row."""
    return splits.agg(
        *[F.count_if(F.col("split") == name).alias(name) for name in ("train", "val", "test")]
    )
