"""Counts, previews, samples and length statistics over example rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.functions import text
from graphsets.functions.draws import draw
from graphsets.operators.ranking import draw_ranked, group_indexed, indexed, joined_on, least_leads, least_led, lowest, with_lead
from graphsets.schema import EXPLANATION_LABEL, INFERENCE_PRIORITY, SPLITS
from graphsets.session import durable, small_side


def _count() -> Column:
    return F.count(F.lit(1))


def split_kind_counts(rows: DataFrame) -> DataFrame:
    """Rows per split, and per kind within it."""
    kinds = ["observation", "explanation", "instruction"]
    return rows.groupBy("split").agg(
        _count().alias("total"),
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds],
    )


def observation_type_counts(rows: DataFrame) -> DataFrame:
    """Observations per split and inference type; a mixed row counts for each of its types."""
    none = F.coalesce(F.size("inference_types"), F.lit(0)) <= 0
    types = F.when(none, F.array("primary_inference_type")).otherwise(F.col("inference_types"))
    return (
        rows.filter(F.col("kind") == "observation")
        .select("split", F.explode(types).alias("inference_type"))
        .groupBy("split", "inference_type")
        .agg(_count().alias("n"))
    )


def explanation_type_counts(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("kind") == "explanation")
        .groupBy("split", text.or_unknown(F.col("explanation_type")).alias("explanation_type"))
        .agg(_count().alias("n"))
    )


def relationship_truths(rows: DataFrame) -> DataFrame:
    """Relationship rows with the relation that their answer states, as ``label``."""
    return rows.filter(
        (F.col("kind") == "explanation") & (F.col("explanation_type") == "relationship")
    ).withColumn("label", text.relation_answer_type(F.col("answer")))


def relationship_truth_counts(rows: DataFrame) -> DataFrame:
    return relationship_truths(rows).groupBy("label").agg(_count().alias("n"))


def truth_counts(rows: DataFrame) -> DataFrame:
    """Relation labels per split and over all splits (split ``all``), in one pass."""
    sets = relationship_truths(rows).groupingSets(
        [["split", "label"], ["label"]], "split", "label"
    )
    return sets.agg(_count().alias("n"), F.grouping("split").alias("_all")).select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("split")).alias("split"), "label", "n"
    )


def type_distribution(rows: DataFrame) -> DataFrame:
    """Rows per split and primary type, and explanations again by explanation type.

    ``explanation_type`` is null on the rows of a whole primary type.
    """
    named = rows.select(
        "split",
        "primary_inference_type",
        text.or_unknown(F.col("explanation_type")).alias("explanation_type"),
    )
    sets = named.groupingSets(
        [["split", "primary_inference_type"], ["split", "primary_inference_type", "explanation_type"]],
        "split", "primary_inference_type", "explanation_type",
    )
    return (
        sets.agg(_count().alias("n"), F.grouping("explanation_type").alias("_whole"))
        .filter((F.col("_whole") == 1) | (F.col("primary_inference_type") == EXPLANATION_LABEL))
        .drop("_whole")
    )


def distinct_types(rows: DataFrame) -> DataFrame:
    """Distinct explanation types of explanation rows, in order."""
    return (
        rows.filter(F.col("kind") == "explanation")
        .select(text.or_unknown(F.col("explanation_type")).alias("explanation_type"))
        .distinct()
        .orderBy("explanation_type")
    )


def render_counts(counts: DataFrame, keys: list[str], label: str, n: str) -> DataFrame:
    """``a=1, b=2`` per group, sorted by label; the groups' labels are already counted."""
    pairs = F.array_sort(F.collect_list(F.struct(label, n)))
    shown = F.transform(pairs, lambda p: F.concat(p[label], F.lit("="), p[n].cast("string")))
    joined = F.array_join(shown, ", ")
    return counts.groupBy(*keys).agg(F.when(joined == "", "none").otherwise(joined).alias("counts"))


def split_breakdown(rows: DataFrame) -> DataFrame:
    """One line per split, with ``none`` where a split has no row of a sort."""
    spark = rows.sparkSession
    out = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    for name, counts, label in (
        ("observation_types", observation_type_counts(rows), "inference_type"),
        ("explanation_types", explanation_type_counts(rows), "explanation_type"),
        ("relationship_truths", relationship_truths(rows).groupBy("split", "label").agg(_count().alias("n")), "label"),
    ):
        shown = render_counts(counts, ["split"], label, "n").withColumnRenamed("counts", name)
        out = out.join(shown, "split", "left").withColumn(name, F.coalesce(name, F.lit("none")))
    return out


def first_example_per_type(rows: DataFrame, order: str = "row_key") -> DataFrame:
    """The first row of each split, kind and type; types without a row are listed with nulls.

    Rows are told apart by their sets of types, which are few, and texts are made for the candidates only.
    """
    spark = rows.sparkSession
    types = F.when(F.col("kind") == "observation", F.col("inference_types")).when(
        F.col("kind") == "explanation", F.array("explanation_type")
    ).otherwise(F.array("kind"))
    typed = rows.select("split", "kind", order, "prompt", "completion", types.alias("_types"))
    sets = least_leads(typed, ["split", "kind", "_types"], order).select(
        "split", "kind", F.explode("_types").alias("type"), "_least"
    )
    key = ["split", "kind", "type"]
    groups = small_side(sets.groupBy(*key).agg(F.min("_least").alias("_least")))
    led = with_lead(typed, groups, order)
    found = led.withColumn("type", F.explode("_types")).groupBy(*key).agg(
        F.min(order).alias("row_key"),
        F.min_by("prompt", order).alias("prompt"),
        F.min_by("completion", order).alias("completion"),
    )
    first = durable(joined_on(groups.select(*key), found, key, "left"))
    seen = first.filter(F.col("kind") == "explanation").select("kind", "type").distinct()
    fixed = spark.createDataFrame([("observation", t) for t in INFERENCE_PRIORITY], "kind string, type string")
    slots = fixed.unionByName(seen).withColumn(
        "split", F.explode(F.array(*[F.lit(s) for s in SPLITS]))
    )
    instructions = first.filter(F.col("kind") == "instruction")
    return slots.join(first, ["split", "kind", "type"], "left").unionByName(
        instructions, allowMissingColumns=True
    )


def split_preview(rows: DataFrame, order: str = "row_key") -> DataFrame:
    """Size and first row of each split that has rows."""
    shown = ["prompt", "completion", "answer"]
    groups, least = least_led(rows.select("split", order, *shown), ["split"], order)
    first = least.groupBy("split").agg(*[F.min_by(name, order).alias(name) for name in shown])
    return joined_on(groups, first, ["split"], "left").select("split", "n", *shown)


def example_index(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``example_id``, the 0-based position within the split."""
    return group_indexed(rows, ["split"], order, "example_id")


def seeded_shuffle(rows: DataFrame, row_key: str, seed: int) -> DataFrame:
    """Add ``position``, the row's 0-based place in the seed's permutation."""
    drawn = rows.withColumn("_draw", draw(seed, "shuffle", row_key))
    ranked = draw_ranked(drawn, [], "_draw", [row_key], "_rank")
    return ranked.withColumn("position", F.col("_rank") - 1).drop("_draw", "_rank", "group_rows")


def stride_sample(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Every ``max(1, n // size)``-th row and of those the first ``size``; all if n <= size.

    Only the order columns are sorted and written; the rows themselves are read at the
    chosen positions. Rows that tie on ``order`` are counted by all their columns.
    """
    placed = indexed(rows.select(*order), order, "_idx")
    total = placed.count()
    if total <= size:
        return rows
    step = max(1, total // size)
    chosen = durable(placed.filter((F.col("_idx") % step == 0) & (F.col("_idx") < step * size)))  # size rows
    keys = F.broadcast(chosen.select(*order).distinct())
    begins = joined_on(placed, keys, order).groupBy(*order).agg(F.min("_idx").alias("_begin"))
    ties = Window.partitionBy(*order).orderBy(*rows.columns)
    met = joined_on(rows, F.broadcast(begins), order).withColumn("_idx", F.col("_begin") + F.row_number().over(ties) - 1)
    return met.join(F.broadcast(chosen.select("_idx")), "_idx", "left_semi").select(*rows.columns)


def eval_subset(rows: DataFrame, cap: int, example_id: str, seed: int) -> DataFrame:
    """A seeded sample of exactly ``min(cap, n)`` rows, back in id order."""
    drawn = rows.withColumn("_draw", draw(seed, "eval", example_id))
    return lowest(drawn, [], "_draw", [example_id], cap).drop("_draw").orderBy(example_id)


def natural_keys(rows: DataFrame, name: str, prefix: str) -> tuple[DataFrame, list[str]]:
    """Sort columns that put names ending in ``prefix<digits>`` first, by that number.

    Numbers of any size compare by their digits: first how many, then which.
    """
    digits = F.regexp_extract(name, prefix + r"(\d+)$", 1)
    numbered = digits != ""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    keyed = (
        rows.withColumn("_plain", F.when(numbered, 0).otherwise(1))
        .withColumn("_size", F.when(numbered, F.length(bare)))
        .withColumn("_number", F.when(numbered, bare))
    )
    return keyed, ["_plain", "_size", "_number", name]


def natural_order(rows: DataFrame, name: str, prefix: str) -> DataFrame:
    """Rows sorted by the number at the end of the name, other names behind."""
    keyed, order = natural_keys(rows, name, prefix)
    return keyed.orderBy(*order).drop("_plain", "_size", "_number")


def _stat_row(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """min, avg, p50, p95, max per group from a histogram (…keys, length, n).

    p50 is the value at index ``n // 2`` and p95 at ``int(0.95 n) - 1`` of the
    sorted values, index -1 being the last. Only distinct lengths are sorted.
    """
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("length"))
    total = F.sum("n").over(group)
    placed = lengths.select("*", upto.alias("_upto"), total.alias("_total"))
    middle = F.floor(F.col("_total") / 2)
    high = F.floor(F.col("_total") * F.lit(0.95)) - 1
    high = F.when(high < 0, F.col("_total") - 1).otherwise(high)
    return placed.groupBy(*keys).agg(
        F.max("_total").alias("n"),
        F.min("length").alias("min_len"),
        (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("avg_len"),
        F.min(F.when(F.col("_upto") > middle, F.col("length"))).alias("p50_len"),
        F.min(F.when(F.col("_upto") > high, F.col("length"))).alias("p95_len"),
        F.max("length").alias("max_len"),
    )


def length_stats(
    rows: DataFrame, prompt: str | None = "prompt", completion: str | None = "completion", length=text.token_count,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Length statistics of prompts, completions and both together, per group of ``by``.

    ``length`` maps a text column to its length; take ``stride_sample`` of the
    rows first to look at a sample. A table without one of the texts gives None
    for its name, and has statistics of the other only.
    """
    found = {name: F.col(f"_{name}") for name, column in (("prompt", prompt), ("completion", completion)) if column}
    if len(found) == 2:
        found["total"] = found["prompt"] + found["completion"]
    columns = {"prompt": prompt, "completion": completion}
    measured = rows.select(*by, *[length(F.col(columns[n])).alias(f"_{n}") for n in found if n != "total"])
    parts = F.array(*[F.struct(F.lit(n).alias("part"), v.alias("length")) for n, v in found.items()])
    histogram = measured.select(*by, F.inline(parts)).groupBy(*by, "part", "length").agg(_count().alias("n"))
    return _stat_row(histogram, [*by, "part"])


def batch_prompt_lengths(
    rows: DataFrame, order: list[str], batch_size: int, prompt: str = "prompt", length=text.token_count
) -> DataFrame:
    """Shortest, longest and mean prompt of each run of ``batch_size`` rows."""
    measured = rows.select(*order, length(F.col(prompt)).alias("_len"))
    batch = F.floor(F.col("_idx") / batch_size)
    return (
        indexed(measured, order, "_idx")
        .groupBy(batch.alias("batch"))
        .agg(
            _count().alias("n"),
            F.min("_len").alias("min_len"),
            F.max("_len").alias("max_len"),
            F.avg("_len").alias("mean_len"),
        )
    )


def prompt_overflow(rows: DataFrame, limit: int, prompt: str = "prompt", length=text.token_count) -> DataFrame:
    """Rows whose prompt is longer than ``limit``, with the length."""
    return rows.withColumn("prompt_len", length(F.col(prompt))).filter(F.col("prompt_len") > limit)


def require_prompts_fit(rows: DataFrame, limit: int, prompt: str = "prompt", length=text.token_count) -> DataFrame:
    """The same rows; computing one that is too long is an error."""
    size = length(F.col(prompt))
    problem = F.concat(
        F.lit("prompt length overflow: "), size.cast("string"), F.lit(f" words, at most {limit} fit")
    )
    return rows.withColumn(
        prompt, F.when(size <= limit, F.col(prompt)).otherwise(F.raise_error(problem).cast("string"))
    )


def eval_split_fanout(rows: DataFrame, base: str = "validation") -> DataFrame:
    """Evaluation rows with ``eval_split``: the whole, and explanations again by type.

    A type's split is named by its slug. If two types share a slug, the first
    in sort order owns the name and the other's rows get no split of their own.
    """
    stem = f"{base}_{EXPLANATION_LABEL}_type_"
    named = rows.withColumn("_type", text.or_unknown(F.col("explanation_type")))
    rules = named.filter(F.col("primary_inference_type") == EXPLANATION_LABEL)
    owners = (
        rules.select("_type")
        .distinct()
        .groupBy(F.concat(F.lit(stem), text.metric_slug(F.col("_type"))).alias("eval_split"))
        .agg(F.min("_type").alias("_type"))
    )
    typed = rules.join(small_side(owners), "_type")
    return named.withColumn("eval_split", F.lit(base)).unionByName(typed).drop("_type")
