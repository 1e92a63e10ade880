"""Scoring of generated answers.

Samples are scored as rows (example_id, sample_idx, generated_text, answer, …),
so an example with very many samples is spread like any other rows. Arrays per
example appear only in the nested report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsets.functions.answers import canonical_ascii, last_boxed, normal_form, pass_at_k
from graphsets.session import durable

# What a prediction record takes over from its example.
RECORD = (
    "prompt", "answer", "canonical_answer", "primary_inference_type", "inference_types", "explanation_type", "query_entity",
)


def columns_to_rows(generations: DataFrame) -> DataFrame:
    """One row per sample from the list columns of a generation table."""
    rest = [c for c in generations.columns if c not in ("generated_text", "token_ids")]
    return generations.select(
        *rest, F.posexplode("generated_text").alias("sample_idx", "generated_text")
    ).withColumn("sample_idx", F.col("sample_idx").cast("bigint"))


def rows_to_columns(samples: DataFrame) -> DataFrame:
    """Back to one row per example with its texts in sample order."""
    rest = [c for c in samples.columns if c not in ("sample_idx", "generated_text")]
    ordered = F.array_sort(F.collect_list(F.struct("sample_idx", "generated_text")))
    return samples.groupBy(*rest).agg(
        F.transform(ordered, lambda s: s["generated_text"]).alias("generated_text")
    )


def canonical_answers(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add ``out``, the comparable form of the answers in ``source``."""
    return df.withColumn(out, canonical_ascii(normal_form(F.col(source))))


def score_samples(samples: DataFrame) -> DataFrame:
    """Add prediction, canonical_prediction, canonical_answer and ``correct`` (0/1).

    A sample without a box is wrong. If ``samples`` already have canonical_answer, made
    once per example, it is used as it is.
    """
    read = samples.withColumn("prediction", last_boxed(F.col("generated_text")))
    if "canonical_answer" not in samples.columns:
        read = canonical_answers(read, "answer", "canonical_answer")
    right = F.col("canonical_prediction") == F.col("canonical_answer")
    return canonical_answers(read, "prediction", "canonical_prediction").withColumn(
        "correct", F.coalesce(right, F.lit(False)).cast("bigint")
    )


def example_accuracy(scored: DataFrame, keep: tuple[str, ...] = ("primary_inference_type",)) -> DataFrame:
    """Samples, correct samples and accuracy per example."""
    return (
        scored.groupBy("example_id", *keep)
        .agg(F.count(F.lit(1)).alias("samples"), F.sum("correct").alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("samples"))
    )


def pass_at_k_table(examples: DataFrame, max_k: int) -> DataFrame:
    """Mean pass@k over examples for k = 1..max_k.

    Examples are first counted by (samples, correct), so k only multiplies
    those few pairs.
    """
    pairs = examples.groupBy("samples", "correct").agg(F.count(F.lit(1)).alias("_n"))
    ks = pairs.withColumn("k", F.explode(F.expr(f"sequence(1L, {int(max_k)}L)")))
    value = pass_at_k(F.col("samples"), F.col("correct"), F.col("k"))
    return ks.groupBy("k").agg((F.sum(value * F.col("_n")) / F.sum("_n")).alias("pass_at_k"))


def accuracy_by_type(examples: DataFrame) -> DataFrame:
    """Mean example accuracy per primary type; a null type stays a group."""
    return examples.groupBy("primary_inference_type").agg(
        F.count(F.lit(1)).alias("examples"), F.avg("accuracy").alias("accuracy")
    )


def scorecard(examples: DataFrame, max_k: int) -> DataFrame:
    """All metrics as (metric, value): accuracy, pass@k and accuracy per type.

    The example scores are computed once, and read for each kind of metric.
    """
    examples = durable(examples.select("primary_inference_type", "samples", "correct", "accuracy"))
    overall = examples.agg(F.avg("accuracy").alias("value")).select(F.lit("accuracy").alias("metric"), "value")
    passes = pass_at_k_table(examples, max_k).select(
        F.concat(F.lit("pass_at_"), F.col("k").cast("string")).alias("metric"),
        F.col("pass_at_k").alias("value"),
    )
    types = accuracy_by_type(examples).select(
        F.concat(F.lit("acc_"), F.coalesce("primary_inference_type", F.lit("None"))).alias("metric"),
        F.col("accuracy").alias("value"),
    )
    return overall.unionByName(passes).unionByName(types)


def prediction_report(
    scored: DataFrame, max_k: int, keep: tuple[str, ...] = RECORD
) -> DataFrame:
    """One nested record per example: scores, texts and predictions in sample order.

    The columns ``keep`` are the example's own, equal in all its samples; those that
    ``scored`` lacks are left out.
    """
    keep = tuple(name for name in keep if name in scored.columns)
    sample = F.struct("sample_idx", "generated_text", "prediction", "canonical_prediction")
    ordered = F.array_sort(F.collect_list(sample))
    own = [F.first(name).alias(name) for name in keep]
    grouped = scored.groupBy("example_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("correct").alias("correct"), ordered.alias("_s"), *own
    )
    scores = F.map_from_entries(
        F.transform(
            F.sequence(F.lit(1), F.lit(max_k)),
            lambda k: F.struct(k, pass_at_k(F.col("samples"), F.col("correct"), k)),
        )
    )
    return grouped.select(
        "example_id",
        *keep,
        (F.col("correct") / F.col("samples")).alias("accuracy"),
        scores.alias("pass_at_k"),
        F.transform("_s", lambda s: s["prediction"]).alias("predictions"),
        F.transform("_s", lambda s: s["canonical_prediction"]).alias("canonicalized_predictions"),
        F.transform("_s", lambda s: s["generated_text"]).alias("texts"),
    )


def compare_models(one: DataFrame, two: DataFrame, labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two models' example scores side by side; an example may be missing in one."""
    sides = [
        side.select(
            "example_id",
            F.col("samples").alias(f"samples_{label}"),
            F.col("correct").alias(f"correct_{label}"),
        )
        for side, label in zip((one, two), labels)
    ]
    return sides[0].join(sides[1], "example_id", "full")
