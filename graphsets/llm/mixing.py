"""Mixing of sources to target weights by weighted sampling without replacement.

A document's key is an exponential draw divided by its quality weight; the lowest
keys of a source come first. A source's target is met by complete epochs and then by
its documents in key order up to the rest. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.llm.prefix import running_sums
from graphsets.llm.store import saved

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *columns: str) -> Column:
    """A repeatable draw, above 0 and below 1, from the named columns (null: empty)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 48)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size), one row for each source.

    Targets share the sum of all sizes by weight. None is above ``most`` times its
    source's size: with sources in order of that limit per weight, those come to their
    limit whose level the words still suffice for, and the others share what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    limited = sources.withColumn("weight", cycle.cast("long")).withColumn("_limit", F.col("source_size") * most)
    by_level = Window.orderBy((F.col("_limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    levels = limited.select(
        "*",
        F.coalesce(F.sum("_limit").over(before), F.lit(0)).alias("_spent"),
        F.sum("weight").over(onward).alias("_open"),
        F.sum("source_size").over(Window.partitionBy()).alias("_all"),
    )
    full = F.col("_spent") * F.col("weight") + F.col("_limit") * F.col("_open") <= F.col("_all") * F.col("weight")
    level = F.first(F.when(~full, (F.col("_all") - F.col("_spent")) / F.col("_open")), ignorenulls=True)
    return levels.withColumn("_full", full).withColumn(
        "_level", level.over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).withColumn(
        "target", F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(F.col("_level") * F.col("weight"))
    ).select("source", "source_size", "weight", "target")


def mix(rows: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Add source_size, target, epochs and taken to (doc_id, source, size, quality, _tie).

    ``quality`` is a weight above 0. A null source is a source of its own. A document
    is taken ``epochs`` times, and once more if the middle of its words falls before the
    rest of the target; so a source misses its target by half a document at most. Rows
    that are alike get places in any order. No rows give no rows.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    keyed = saved(
        rows.withColumn("_source", name).withColumn(
            "_key", -F.log(uniform(seed, "doc_id", "_tie")) / F.col("quality")
        ),
        "keyed",
    )
    sizes = keyed.groupBy("_source", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most).withColumn(
        "_source", name
    ).drop("source")
    ordered = running_sums(keyed, ["_key", "doc_id", "_tie"], {"start": "size"}, ["_source"])
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (F.col("start") + F.col("size") / 2 <= rest) & (F.col("epochs") < most)
    return (
        ordered.join(targets, "_source")
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("copies", F.col("epochs") + chosen.cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("_source", "_key")
    )


def quality_weights(labels: DataFrame, low: float = 0.25, unknown: float = 0.5) -> DataFrame:
    """(doc_id, quality): 1 for good documents, ``low`` for bad ones; the best of several labels counts.

    Documents without a label weigh ``unknown``, which the caller fills in.
    """
    best = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_best"))
    return best.select("doc_id", F.when(F.col("_best") >= 1, 1.0).when(F.col("_best") < 1, low).otherwise(unknown).alias("quality"))


def mix_documents(docs: DataFrame, labels: DataFrame, unknown: float = 0.5) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source) with weights from ``labels`` (doc_id, quality)."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.coalesce(F.md5("text"), F.lit("")).alias("_tie"))
    rated = narrow.join(quality_weights(labels, unknown=unknown), "doc_id", "left").fillna({"quality": unknown})
    return mix(rated)
