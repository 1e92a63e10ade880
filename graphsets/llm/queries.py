"""One query for each operator of this folder, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsets.llm import decontam, jaccard, langid, lexical, linecrf, lines, maxscore, mixing, phrases, records, shards, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the captures of all pages."""
    found = warc.resolve_revisits(warc.page_captures(table(spark, sf_dir, "pages")))
    header = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        F.col("record_id").alias("revisit_id"), "url_key", "response_id", "status",
        F.array_join(header, "\n").alias("headers"), F.md5("payload").alias("payload_md5"),
    )


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of all documents, written as records and read back."""
    manifest = records.write_records(table(spark, sf_dir, "documents"), records.session_tokenizer())

    return records.read_records(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every fiftieth."""
    vectors = maxscore.integer_vectors(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the lines that ten documents share."""
    docs = lines.numbered(table(spark, sf_dir, "documents"))
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=10, min_chars=1, keep_first=False))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of equal bytes."""
    return shards.document_shards(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds an item of the benchmark."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of every document."""
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "group_id", "copies", "links", "linked_docs")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for each item of the benchmark."""
    return lexical.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), top=2000, min_count=30)


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linecrf.judge(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_revisit_resolution, op2_token_records, op3_weighted_mix, op4_maxscore_top_k, op5_line_dedup, op6_byte_shards,
        op7_language_id, op8_decontamination, op9_jaccard_join, op10_toxicity, op11_lexical_search, op12_phrase_mining, op13_line_quality, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    folder = Path(__file__).parent / "sql"
    return {path.stem: path.read_text() for path in sorted(folder.glob("*.sql"))}
