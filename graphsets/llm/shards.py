"""Contiguous shards of nearly equal bytes.

Sizes are summed over the global order from the totals of its ranges; the sum is cut
at equal targets. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsets.llm.prefix import running_sums
from graphsets.llm.store import saved

ROW_BYTES = 16


def byte_shards(rows: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """Add ``shard`` (0 to shards - 1), ``slot`` (position in the shard) and ``start`` (bytes before).

    A row goes to the shard in which its middle byte falls, so shards are contiguous
    in ``order`` and miss the target by one row at each end at most. Sizes must be
    integers of 0 or more; where all are 0, all rows go to shard 0. Equal rows in
    ``order`` get places in any order. An empty table gives an empty result.
    """
    placed = saved(running_sums(rows, order, {"start": size, "_row": F.lit(1)}), "placed")
    total = max(1, placed.agg(F.sum(size)).first()[0] or 1)
    shard = F.least(F.lit(shards - 1), F.expr(f"((2 * start + `{size}`) * {shards}) div {2 * total}"))
    cut = placed.withColumn("shard", shard.cast("int"))
    first = cut.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row for each shard
    return cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_first")


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, start) of every document, in order of doc_id.

    Size is the text's UTF-8 bytes (null: 0) plus 16. Null doc_ids come first; equal
    doc_ids follow the hash of their texts. Columns beyond doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_tie"),
    )
    return byte_shards(narrow, ["doc_id", "_tie"], "size", shards).drop("_tie")
