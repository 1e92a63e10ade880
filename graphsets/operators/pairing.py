"""Joins that pair the members of a group.

They are used only where the pairs are the result asked for. A group may be
large, so its left members are salted into parts that run apart, and the right
members, few next to the pairs, are copied to every part. How many parts a group
has follows from its size: small groups stay whole and are copied once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsets.session import dealt, is_dealt_once, spread

PART_ROWS = 256
HUB_ROWS = 4096
MOST_HUBS = 10_000


def parts_of(left: DataFrame, on: list[str]) -> DataFrame:
    """(on, _parts): one part for each ``PART_ROWS`` left members of a group."""
    return left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts"))


def salted(left: DataFrame, on: list[str], by: str, parts: DataFrame) -> DataFrame:
    """Spread group members over the group's parts by the column ``by``."""
    placed = left.join(dealt(parts), on).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))
    return spread(placed.drop("_parts"), *on, "_salt")


def copied(right: DataFrame, on: list[str], parts: DataFrame) -> DataFrame:
    """The other side, once per part."""
    numbers = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return right.join(dealt(parts), on).withColumn("_salt", numbers).drop("_parts")


def pair_members(left: DataFrame, right: DataFrame, on: list[str], by: str) -> DataFrame:
    """Equi join of two sides of the same groups, split by salt."""
    parts = parts_of(left, on)
    return salted(left, on, by, parts).join(dealt(copied(right, on, parts)), [*on, "_salt"]).drop("_salt")


def hub_join(rows: DataFrame, keyed: DataFrame, on: list[str], by: str, counted: str) -> DataFrame:
    """Equi join of ``rows`` with one row per key, whose column ``counted`` is the number of rows of the key.

    Keys above a counted limit are hubs: their rows are cut into parts by the column ``by``, and
    their one row is copied to each part, so no task has much more than the limit. The
    limit leaves ``MOST_HUBS`` hubs at most, which are broadcast. ``keyed`` is read three
    times, so it should be written.
    """
    total = keyed.agg(F.sum(counted)).first()[0] or 0
    limit = max(HUB_ROWS, -(-total // MOST_HUBS))
    parts = F.ceil(F.col(counted) / limit).cast("int")
    hubs = F.broadcast(keyed.filter(F.col(counted) > limit).select(*on, parts.alias("_parts")))
    cut = rows.join(hubs, on, "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))
    )
    copies = F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)) * (F.col(counted) > limit).cast("int")))
    return cut.drop("_parts").join(dealt(keyed.withColumn("_part", copies).drop(counted)), [*on, "_part"]).drop("_part")


def near_join(rows: DataFrame, table: DataFrame, on: str, where: Column | list[str], how: str = "inner") -> DataFrame:
    """Join rows with a table that has few rows for each ``on``, dealt by ``on`` alone.

    ``where`` is compared within ``on``: a condition, or further columns that both sides have and that must be
    equal. Joins that follow each other on the same ``on`` share one shuffle of the rows, which
    are never sorted; the table is never broadcast. ``table`` should not hold hot keys. Inside ``dealt_once``
    columns are looked up by hash, else they are compared with each row of their ``on``.
    """
    keys = [on, *(where if isinstance(where, list) else [])]
    names = {key: f"_on_{number}" for number, key in enumerate(keys)}
    if is_dealt_once(rows.sparkSession):
        equal = [F.col(key) == F.col(names[key]) for key in keys[1:]]
    else:  # As an equality, Spark would deal both sides by these columns too.
        equal = [F.col(key).between(F.col(names[key]), F.col(names[key])) for key in keys[1:]]
    within = reduce(Column.__and__, equal, F.col(on) == F.col(names[on]))
    if not isinstance(where, list):
        within = within & where
    return rows.join(table.withColumnsRenamed(names).hint("shuffle_hash"), within, how).drop(*names.values())
