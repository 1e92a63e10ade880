"""Observation, explanation and instruction rows.

Rows are built narrow, with ``family`` and ``template_idx`` in place of text,
so that caps move few bytes; ``render`` adds the texts at the end. ``row_key``
names a row for its draws.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.functions import text
from graphsets.functions.templates import fan_out, wording
from graphsets.operators.closure import pair_relations
from graphsets.operators.graph import WORD, adjacency, ordered_pairs
from graphsets.operators.pairing import near_join
from graphsets.operators.ranking import indexed, joined_on
from graphsets.operators.splits import strictest_split
from graphsets.schema import EXAMPLE_COLUMNS, EXPLANATION_LABEL, EXPLANATION_TYPES, INSTRUCTION_LABEL
from graphsets.session import dealt, small_side


def _empty() -> Column:
    return F.array().cast("array<string>")


def observe(rows: DataFrame, words: DataFrame, max_obs_size: int, near: bool = False) -> DataFrame:
    """Look up the values of specs in their worlds.

    ``rows(graph_idx, world_id, query_entity, observed_entities, ...)`` and packed facts.
    Adds observed_values and answer ("1"/"0"); a query entity without a fact is an error.
    One equi join per slot, on (graph, entity, word); facts hold 64 worlds per row and are broadcast if their
    counted number allows. If all graphs are small (``near``), one shuffle serves all slots.
    """
    words = words.select("graph_idx", "entity", "word", "bits")
    words = words if near else small_side(words)
    rows = rows.withColumn("word", F.expr(f"cast(world_id div {WORD} as int)"))
    truth = text.truth_label(F.expr(f"getbit(_bits, cast(world_id % {WORD} as int)) = 1"))

    def look_up(df, entity, out, needed):
        facts = words.select(
            "graph_idx", F.col("entity").alias("_e"), "word", F.col("bits").alias("_bits")
        )
        asked, key = df.withColumn("_e", entity), ["graph_idx", "_e", "word"]
        joined = near_join(asked, facts, key[0], key[1:], "left") if near else asked.join(facts, key, "left")
        value = F.when(F.col("_bits").isNotNull(), truth)
        if needed:
            missing = F.concat(F.lit("no fact of "), F.coalesce("_e", F.lit("null")), F.lit(" in world "), "world_id")
            value = value.otherwise(F.raise_error(missing).cast("string"))
        return joined.withColumn(out, value).drop("_e", "_bits")

    rows = look_up(rows, F.col("query_entity"), "answer", True)
    slots = [f"_v{slot}" for slot in range(max_obs_size)]
    for slot, name in enumerate(slots):
        rows = look_up(rows, F.get("observed_entities", F.lit(slot)), name, False)
    return rows.withColumn(
        "observed_values", F.slice(F.array(*slots), F.lit(1), F.size("observed_entities"))
    ).drop(*slots, "word")


def observation_rows(observed: DataFrame, num_templates: int) -> DataFrame:
    """Narrow observation rows, one per wording; always in the train split."""
    family = F.when(F.size("observed_entities") == 1, "observation_single").otherwise(
        "observation_multi"
    )
    rows = fan_out(observed.withColumn("family", family), num_templates)
    return rows.withColumn("kind", F.lit("observation")).withColumn("split", F.lit("train")).withColumn(
        "row_key",
        F.concat_ws("|", F.lit("o"), "graph_idx", "world_id", "spec_ord", "template_idx"),
    )


def fact_texts(entities: Column, values: Column) -> Column:
    return F.zip_with(entities, values, lambda e, v: F.concat(e, F.lit(" is "), v))


def state_facts(observed: DataFrame) -> DataFrame:
    """Add the texts of the observed facts; before there is a row for each wording, they are made once."""
    facts = fact_texts(F.col("observed_entities"), F.col("observed_values"))
    return observed.withColumns({"_every": F.array_join(facts, " and "), "_commas": F.array_join(facts, ", ")})


def render_observations(rows: DataFrame) -> DataFrame:
    """Example rows of narrow observation rows; facts that are not stated yet are stated."""
    every = F.col("_every")
    values = {"{F}": every, "{A}": every, "{C}": F.col("_commas"), "{Q}": F.col("query_entity")}
    return (
        (rows if "_every" in rows.columns else state_facts(rows))
        .withColumn("prompt", wording(["observation_single", "observation_multi"], values))
        .withColumn("completion", text.boxed(F.col("answer")))
        .withColumn("explanation_type", F.lit(None).cast("string"))
        .select(*EXAMPLE_COLUMNS, "row_key")
    )


def rule_answers(linked: DataFrame) -> DataFrame:
    """(graph_idx, entity, answer) with the rule of every node."""
    called = F.concat(
        "entity", F.lit(" = "), "rule", F.lit("("), F.array_join("parents", ", "), F.lit(")")
    )
    root = F.concat("entity", F.lit(" is a root node"))
    answer = F.when(F.size("parents") == 0, root).otherwise(called)
    return linked.select("graph_idx", "entity", answer.alias("answer"))


def neighbour_answers(linked: DataFrame, neighbours: str) -> DataFrame:
    """(graph_idx, entity, answer) with the neighbours, for nodes that have any."""
    return linked.filter(F.size(neighbours) > 0).select(
        "graph_idx", "entity", F.array_join(neighbours, " and ").alias("answer")
    )


def _explanation(rows: DataFrame, family: str, num_templates: int) -> DataFrame:
    """Narrow rows from (graph_idx, query_entity, first, second, answer, split)."""
    tagged = rows.withColumn("family", F.lit(family))
    return fan_out(tagged, num_templates).select(
        "graph_idx", "query_entity", "first", "second", "answer", "split", "family", "template_idx",
        F.lit("explanation").alias("kind"),
        F.col("family").alias("explanation_type"),
        F.concat_ws("|", F.lit("e"), "graph_idx", "family", "query_entity", "template_idx").alias("row_key"),
    )


def single_explanations(
    answers: DataFrame, splits: DataFrame, family: str, num_templates: int
) -> DataFrame:
    """Narrow rows about one entity, in the entity's split."""
    rows = answers.join(dealt(splits), ["graph_idx", "entity"]).select(
        "graph_idx",
        F.col("entity").alias("query_entity"),
        F.col("entity").alias("first"),
        F.lit(None).cast("string").alias("second"),
        "answer",
        "split",
    )
    return _explanation(rows, family, num_templates)


def relationship_explanations(
    nodes: DataFrame, related: DataFrame, splits: DataFrame, num_templates: int, per_component: bool = False
) -> DataFrame:
    """Narrow rows about every ordered pair, in both directions.

    Splits are attached to the nodes, before there are pairs.
    """
    owned = nodes.join(dealt(splits.select("graph_idx", "entity", "split")), ["graph_idx", "entity"], "left")
    pairs = pair_relations(ordered_pairs(owned, per_component, numbered=True), related)
    mentioned = strictest_split(F.col("first_split"), F.col("second_split"))
    rows = pairs.withColumn("split", mentioned).select(
        "graph_idx",
        F.concat("first", F.lit("->"), "second").alias("query_entity"),
        "first",
        "second",
        text.relation_text(F.col("relation"), F.col("first"), F.col("second")).alias("answer"),
        "split",
    )
    return _explanation(rows, "relationship", num_templates)


def explanation_parts(
    nodes: DataFrame, edges: DataFrame, related: DataFrame, splits: DataFrame,
    num_templates: int, per_component: bool = False,
) -> list[DataFrame]:
    """Narrow explanation rows, a table for each family: rules, both neighbour lists and relationships."""
    linked = adjacency(nodes, edges)
    return [
        single_explanations(rule_answers(linked), splits, "rule", num_templates),
        single_explanations(neighbour_answers(linked, "parents"), splits, "parent_retrieval", num_templates),
        single_explanations(neighbour_answers(linked, "children"), splits, "child_retrieval", num_templates),
        relationship_explanations(nodes, related, splits, num_templates, per_component),
    ]


def explanation_rows(
    nodes: DataFrame, edges: DataFrame, related: DataFrame, splits: DataFrame,
    num_templates: int, per_component: bool = False,
) -> DataFrame:
    """All narrow explanation rows."""
    return reduce(DataFrame.unionByName, explanation_parts(nodes, edges, related, splits, num_templates, per_component))


def render_explanations(rows: DataFrame) -> DataFrame:
    """Example rows of narrow explanation rows."""
    values = {"{E}": F.col("first"), "{P1}": F.col("first"), "{P2}": F.coalesce("second", F.lit(""))}
    return (
        rows.withColumn("prompt", wording(list(EXPLANATION_TYPES), values))
        .withColumn("completion", text.boxed(F.col("answer")))
        .withColumn("primary_inference_type", F.lit(EXPLANATION_LABEL))
        .withColumn("inference_types", F.array(F.lit(EXPLANATION_LABEL)))
        .withColumn("observed_entities", _empty())
        .withColumn("observed_values", _empty())
        .select(*EXAMPLE_COLUMNS, "row_key")
    )


def first_rows(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """The first ``min(count, rows)`` rows of a total order.

    Only the order columns are sorted, by range, so no task takes the heads of
    all partitions. Of rows that tie on ``order`` at the end, as many as are left are taken, the first by
    all their columns. Nulls come first.
    """
    head = indexed(df.select(*order), order, "_idx").filter(F.col("_idx") < count)
    taken = small_side(head.groupBy(*order).agg(F.count(F.lit(1)).alias("_take")))
    ties = Window.partitionBy(*order).orderBy(*df.columns)
    ranked = joined_on(df, taken, order).withColumn("_tie", F.row_number().over(ties))
    return ranked.filter(F.col("_tie") <= F.col("_take")).select(*df.columns)


def instruction_rows(source: DataFrame, order: list[str], count: int) -> DataFrame:
    """Example rows of the first ``count`` rows of (…order, instruction, output)."""
    taken = first_rows(source, order, count)
    output = text.instruction_answer(F.col("output"))
    return taken.select(
        output.alias("answer"),
        output.alias("completion"),
        F.lit(None).cast("string").alias("explanation_type"),
        F.lit(-1).cast("bigint").alias("graph_idx"),
        F.array(F.lit(INSTRUCTION_LABEL)).alias("inference_types"),
        F.lit("instruction").alias("kind"),
        _empty().alias("observed_entities"),
        _empty().alias("observed_values"),
        F.lit(INSTRUCTION_LABEL).alias("primary_inference_type"),
        text.instruction_prompt(F.col("instruction")).alias("prompt"),
        F.lit("N/A").alias("query_entity"),
        F.lit("train").alias("split"),
        F.concat_ws("|", F.lit("i"), *order).alias("row_key"),
    )


def train_explanation_copies(rows: DataFrame, copies: int) -> DataFrame:
    """Train explanations ``copies`` more times; ``row_key`` tells copies apart."""
    if copies < 0:
        raise ValueError(f"copies must not be negative, got {copies}")
    if copies == 0:
        return rows
    numbers = [F.sequence(F.lit(0), F.lit(last)) for last in (copies, 0)]  # constant arrays
    copied = F.when((F.col("split") == "train") & (F.col("kind") == "explanation"), numbers[0]).otherwise(numbers[1])
    return (
        rows.withColumn("_copy", F.explode(copied))
        .withColumn(
            "row_key",
            F.when(F.col("_copy") == 0, F.col("row_key")).otherwise(
                F.concat_ws("|", "row_key", F.concat(F.lit("copy"), "_copy"))
            ),
        )
        .drop("_copy")
    )
