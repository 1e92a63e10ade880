"""Positions inside groups, safe for groups of any size.

``row_number`` over a group runs in one task, so one hot group would hold up
the job. Here a group is first cut into buckets that follow its order. A small
table of bucket counts gives each bucket its offset, and only the rows of one
bucket are sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.functions.draws import BUCKET_BITS, DRAW_BITS, draw_bucket
from graphsets.session import durable, small_side

# Up to this many kept rows per group are chosen without a look at group sizes.
FEW = 10_000
SALTS = 32
BUCKET_ROWS = 1_000_000
LEAD_BYTES = 7


def joined_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi join in which null keys meet; the columns of ``left`` come first."""
    names = {key: f"_on_{number}" for number, key in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    same = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()])
    return left.join(other, same, how).drop(*names.values())


def _offsets(df: DataFrame, keys: list[str], total: str) -> DataFrame:
    """Rows before each bucket of a group, and rows in the group."""
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    return counts.select(
        *keys,
        "_bucket",
        (F.sum("_rows").over(group.orderBy("_bucket")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(group).alias(total),
    )


def _number(joined: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return joined.withColumn(
        out, (F.col("_before") + F.row_number().over(inside)).cast("bigint")
    ).drop("_bucket", "_before")


def bucket_ranked(
    df: DataFrame, keys: list[str], bucket: Column, order: list, out: str = "rank", total: str = "group_rows"
) -> DataFrame:
    """Add the 1-based rank within ``keys`` and the group's size.

    ``bucket`` must not decrease along ``order``; null keys are a group. Reads
    ``df`` twice, the first time for the keys and the bucket only.
    """
    tagged = df.withColumn("_bucket", bucket)
    return _number(joined_on(tagged, _offsets(tagged, keys, total), [*keys, "_bucket"]), keys, order, out)


def running_before(
    df: DataFrame, keys: list[str], bucket: Column, order: list, value: str, out: str
) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one in its group."""
    tagged = df.withColumn("_bucket", bucket)
    sums = tagged.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")
    offsets = sums.select(*keys, "_bucket", (F.sum("_sum").over(across) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = F.col("_before") + F.sum(value).over(inside) - F.col(value)
    return (
        joined_on(tagged, offsets, [*keys, "_bucket"])
        .withColumn(out, before.cast("bigint"))
        .drop("_bucket", "_before")
    )


def equi_depth(df: DataFrame, keys: list[str], drawn: str, out: str) -> DataFrame:
    """Add a bucket of a group's draw order, with about ``BUCKET_ROWS`` rows or fewer, whatever the group's size.

    Rows are counted in 4,096 intervals of the draws. Neighbouring intervals share a bucket up
    to the bound, and an interval beyond it is cut by further bits of the draws.
    """
    tagged = df.withColumn("_fine", draw_bucket(F.col(drawn)))
    counts = tagged.groupBy(*keys, "_fine").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_fine")) - F.col("_rows")
    cuts = counts.select(
        *keys, "_fine", F.floor(before / BUCKET_ROWS).alias("_home"),
        F.ceil(F.log2(F.greatest(F.col("_rows") / BUCKET_ROWS, F.lit(1.0)))).cast("int").alias("_bits"),
    )
    # Only the last interval of a run of neighbours can be beyond the bound, so buckets follow the draws.
    sub = F.expr(f"shiftright({drawn}, {DRAW_BITS - BUCKET_BITS} - _bits) & (shiftleft(1L, _bits) - 1)")
    bucket = F.struct("_home", F.when(F.col("_bits") > 0, sub + 1).otherwise(F.lit(0)).cast("bigint").alias("_sub"))
    return joined_on(tagged, small_side(cuts), [*keys, "_fine"]).withColumn(out, bucket).drop("_fine", "_home", "_bits")


def draw_ranked(
    df: DataFrame, keys: list[str], drawn: str, tie: list[str], out: str = "rank", total: str = "group_rows"
) -> DataFrame:
    """Rank in draw order, in buckets of bounded size."""
    cut = equi_depth(df, keys, drawn, "_depth")
    return bucket_ranked(cut, keys, F.col("_depth"), [drawn, *tie], out, total).drop("_depth")


def _lowest_few(df: DataFrame, keys: list[str], drawn: str, tie: list[str], keep: int) -> DataFrame:
    order = [F.col(drawn), *tie]
    salted = df.withColumn("_salt", F.pmod(F.col(drawn), F.lit(SALTS)))
    for group in ([*keys, "_salt"], keys or [F.lit(0)]):
        window = Window.partitionBy(*group).orderBy(*order)
        salted = salted.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= keep)
    return salted.drop("_rank", "_salt")


def lowest_thinned(df: DataFrame, keys: list[str], drawn: str, tie: list[str], keep: int, size: str) -> DataFrame:
    """``lowest`` for up to ``FEW`` rows where the column ``size`` tells about how many rows a group has.

    Rows whose draw is too high to be among the lowest of so many are dropped before any sort. A
    group of which too few are left then is ranked whole, so a wrong size costs time and
    changes nothing. Reads ``df`` twice, the second time for the keys only.
    """
    spare = 2 * keep + 32
    cut = F.col(size) > spare
    low = F.col(drawn) < F.lit(float(spare)) / F.col(size) * F.lit(float(1 << DRAW_BITS))
    kept = durable(_lowest_few(df.filter(~cut | low | cut.isNull()), keys, drawn, tie, keep))
    full = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_kept")).filter(F.col("_kept") >= keep).drop("_kept")
    short = durable(joined_on(df.filter(cut).select(*keys).distinct(), full, keys, "left_anti"))
    if short.isEmpty():
        return kept
    again = _lowest_few(joined_on(df, short, keys, "left_semi"), keys, drawn, tie, keep)
    return joined_on(kept, short, keys, "left_anti").unionByName(again)


def lowest(df: DataFrame, keys: list[str], drawn: str, tie: list[str], keep: int) -> DataFrame:
    """Exactly ``min(keep, group size)`` rows per group: those with the lowest draws.

    Up to ``FEW`` rows are taken from the lowest of each salted part of a group, and map
    tasks send no more than that. For a larger ``keep`` a group is cut into buckets,
    and those that start beyond ``keep`` are dropped before rows are shuffled.
    """
    if keep <= FEW:
        return _lowest_few(df, keys, drawn, tie, keep)
    tagged = df.withColumn("_bucket", draw_bucket(F.col(drawn)))
    offsets = _offsets(tagged, keys, "_total").drop("_total").filter(F.col("_before") < keep)
    joined = joined_on(tagged, small_side(offsets), [*keys, "_bucket"])
    return _number(joined, keys, [drawn, *tie], "_rank").filter(F.col("_rank") <= keep).drop("_rank")


def hashed_count() -> Column:
    """The number of rows; least and greatest texts taken beside it are kept by hash.

    Without an aggregate that collects, Spark sorts all rows by the group for them. This one collects nulls, so nothing.
    """
    return F.count(F.lit(1)) + F.size(F.collect_list(F.lit(None).cast("int")))


def _lead(text: str) -> Column:
    """The leading bytes of a text, which follow the order of texts; null for null."""
    return F.expr(f"substring(cast(`{text}` as binary), 1, {LEAD_BYTES})")


def least_leads(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, n, _least) of all groups: how many rows, and the least lead of their ``text``."""
    return df.groupBy(*keys).agg(hashed_count().alias("n"), F.min(_lead(text)).alias("_least"))


def with_lead(df: DataFrame, leads: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` whose ``text`` begins as one of ``leads(_least)`` does.

    A semi join on one column, which Spark moves below a union, and a stage that is compiled as a whole makes columns
    when they are used, so the other columns of ``df`` are made for the rows that are left.
    """
    known = leads.select("_least").distinct()
    return df.withColumn("_lead", _lead(text)).join(small_side(known), F.col("_lead") == F.col("_least"), "left_semi").drop("_lead")


def least_led(df: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(keys, n) of all groups, and the rows that may hold a group's least ``text``.

    These are the rows whose leading bytes are a group's least. The bytes are compared without a sort,
    and only these few rows are sorted afterwards. Reads ``df`` twice, the first time for the keys and ``text`` only.
    """
    groups = small_side(least_leads(df, keys, text))
    return groups.drop("_least"), with_lead(df, groups, text)


def nth_row(df: DataFrame, keys: list[str], drawn: str, tie: list[str], position: int) -> DataFrame:
    """The row at a 1-based position of each group's draw order, if there is one.

    Only the one bucket of a group that holds the position is sorted.
    """
    tagged = df.withColumn("_bucket", draw_bucket(F.col(drawn)))
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket"))
    home = counts.withColumn("_before", upto - F.col("_rows")).filter(
        (F.col("_before") < position) & (F.col("_before") + F.col("_rows") >= position)
    )
    joined = joined_on(tagged, home.drop("_rows"), [*keys, "_bucket"])
    return _number(joined, keys, [drawn, *tie], "_rank").filter(F.col("_rank") == position).drop("_rank")


def indexed(df: DataFrame, order: list, out: str = "row_idx") -> DataFrame:
    """Add the 0-based position in the order of the columns ``order`` (a total order).

    A range partitioned sort plus one offset per partition. The sorted rows are
    written to the shared folder, so a retry cannot move a partition border.
    """
    placed = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    counts = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part")
    offsets = counts.select(
        "_part", (F.sum("_rows").over(before) - F.col("_rows") - F.col("_first")).alias("_shift")
    )
    # One row per partition of the sort.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_pos") + F.col("_shift")).cast("bigint"))
        .drop("_part", "_pos", "_shift")
    )


def group_indexed(df: DataFrame, keys: list[str], order: list, out: str = "row_idx") -> DataFrame:
    """Add the 0-based position within ``keys``, counted from the group's first row."""
    placed = indexed(df, [*keys, *order], out)
    first = placed.groupBy(*keys).agg(F.min(out).alias("_first"))
    return (
        joined_on(placed, small_side(first), keys)
        .withColumn(out, F.col(out) - F.col("_first"))
        .drop("_first")
    )
