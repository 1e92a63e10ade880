"""A corpus pipeline: each stage is one operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsets.llm import decontam, jaccard, langid, mixing, records
from graphsets.llm.store import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters, or like none of them, go."""
    return langid.identify(docs).filter("not rejected").select(*COLUMNS)


def _named(rows: DataFrame, name: str, source: bool = False) -> tuple[DataFrame, list[str]]:
    """Adds columns without nulls that tell documents apart: doc_id, ``name`` of the text, and source if asked."""
    keys = {
        "_unknown": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_text": F.col(name),
        "_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")) if source else None,
    }
    keys = {k: v for k, v in keys.items() if v is not None}
    return rows.withColumns(keys), list(keys)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the first by doc_id; of rows that are alike one stays."""
    found = jaccard.near_duplicates(docs).filter("is_first")
    first, keys = _named(found, "text_hash")
    named, _ = _named(docs.select(*COLUMNS, F.xxhash64("text").alias("_hash")), "_hash")
    return named.join(first.select(*keys), keys, "left_semi").dropDuplicates(keys).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; copies of rows that are alike add up."""
    mixed = mixing.mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    taken, keys = _named(mixed.filter("copies > 0"), "_tie", source=True)
    copies = taken.groupBy(*keys).agg(F.sum("copies").alias("_copies"))
    hashed = docs.select(*COLUMNS, F.coalesce(F.md5("text"), F.lit("")).alias("_hash"))
    named, _ = _named(hashed, "_hash", source=True)
    once = named.groupBy(*keys).agg(*[F.first(c).alias(c) for c in COLUMNS])
    return once.join(copies, keys).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids from the record files: doc_id, start, n_tokens and ids."""
    return records.read_records(records.write_records(docs, records.session_tokenizer()))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mixture),
    ("token_records", token_records),
]

ORACLE_SQL = None  # the first three stages have no SQL form; tests hold the pipeline against plain ones


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
