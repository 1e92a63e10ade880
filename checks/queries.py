"""One query per operator over the derived tables.

Array columns are joined to text, so that any engine can compare them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsets.functions import answers, text, tokens
from graphsets.functions.draws import chance, draw
from graphsets.operators import caps, closure, examples, graph, ranking, report, score, specs, splits
from graphsets.plans import tables as star
from graphsets.plans.tables import SEED, Tables
from graphsets.session import scratch_path
from graphsets.sources import jsonl, metadata

BIN_CAP = 3
COMPONENT = dict(
    per_component_data=True,
    max_observations_per_component_probability_bin=BIN_CAP,
    max_observations=1200,
    max_explanations=2000,
)
MAX_K = 8
LABEL_CAP = 4000
KEY_CAP = 700

_tables: dict = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Derived tables, made once per session and directory."""
    name = (spark.sparkContext.applicationId, str(sf_dir))
    if name not in _tables:
        _tables[name] = Tables(spark, str(sf_dir))
    return _tables[name]


def joined(column: str):
    return F.array_join(column, "|").alias(column)


def flat(rows: DataFrame) -> DataFrame:
    """Example rows with their arrays as text."""
    return rows.select(
        "answer", "completion", "explanation_type", "graph_idx", joined("inference_types"), "kind",
        joined("observed_entities"), joined("observed_values"), "primary_inference_type", "prompt",
        "query_entity", "split",
    )


# graph tables


def candidate_edges(spark, sf):
    made = F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("entity")
    maker = star.table(spark, sf, "part").select(made, "p_brand")
    return graph.candidate_edges(star.nodes(spark, sf).join(maker, "entity"), ["p_brand"])


def bernoulli_rows(spark, sf):
    return star.lines(spark, sf).filter(chance(0.25, draw(SEED, "keep", "row_key"))).select("row_key")


def root_nodes(spark, sf):
    t = tables(spark, sf)
    return graph.root_nodes(star.nodes(spark, sf), t.edges()).select("graph_idx", "entity")


def assign_rules(spark, sf):
    t = tables(spark, sf)
    return graph.assign_rules(star.nodes(spark, sf), t.edges(), 0.6, SEED).select("graph_idx", "entity", "rule")


def adjacency(spark, sf):
    t = tables(spark, sf)
    return graph.adjacency(star.nodes(spark, sf), t.edges()).select(
        "graph_idx", "entity", joined("parents"), joined("children")
    )


def reachability(spark, sf):
    return graph.reachability(tables(spark, sf).edges())


def ancestor_counts(spark, sf):
    return closure.relative_counts(star.nodes(spark, sf), tables(spark, sf).builder().related(), "up", "ancestors")


def descendant_counts(spark, sf):
    return closure.relative_counts(star.nodes(spark, sf), tables(spark, sf).builder().related(), "down", "descendants")


def pair_relations(spark, sf):
    t = tables(spark, sf)
    pairs = graph.ordered_pairs(star.nodes(spark, sf), numbered=True)
    return closure.pair_relations(pairs, t.builder().related())


def weak_components(spark, sf):
    t = tables(spark, sf)
    return graph.weak_components(star.nodes(spark, sf), t.edges()).select(
        "graph_idx", "entity", "component_root", "component_id"
    )


def node_levels(spark, sf):
    t = tables(spark, sf)
    return graph.node_levels(star.nodes(spark, sf), t.edges()).select("graph_idx", "entity", "depth")


def level_widths(spark, sf):
    return graph.level_widths(node_levels(spark, sf))


def root_facts(spark, sf):
    t = tables(spark, sf)
    return graph.unpack_worlds(t.graph_tables().root_words, t.num_worlds())


def rule_propagation(spark, sf):
    t = tables(spark, sf)
    made = t.graph_tables()
    words = graph.propagate(made.nodes, made.edges, made.root_words)
    return graph.unpack_worlds(words, t.num_worlds())


def unresolved_nodes(spark, sf):
    t = tables(spark, sf)
    roots = graph.root_nodes(star.nodes(spark, sf), t.edges())
    return graph.unresolved_nodes(star.nodes(spark, sf), t.edges(), roots).select("graph_idx", "entity")


# splits


def split_exact(spark, sf):
    parts = star.table(spark, sf, "part").select("p_type", "p_partkey")
    return splits.split_exact(parts, ["p_type"], ["p_partkey"], 0.15, 0.25, SEED)


def split_by_graph(spark, sf):
    return splits.split_by_graph(star.nodes(spark, sf), 0.1, 0.1, SEED).select("graph_idx", "entity", "split")


def split_by_node(spark, sf):
    return splits.split_by_node(star.nodes(spark, sf), 0.1, 0.1, SEED).select("graph_idx", "entity", "split")


def explanation_split(spark, sf):
    t = tables(spark, sf)
    return splits.pair_split(graph.ordered_pairs(star.nodes(spark, sf)), t.builder().splits())


def entity_split_counts(spark, sf):
    return splits.entity_split_counts(tables(spark, sf).builder().splits())


# specs and observations


def observation_specs(spark, sf):
    found = specs.observation_specs(star.nodes(spark, sf), 2)
    return found.select("graph_idx", "query_entity", "obs_size", joined("observed_entities"), "spec_ord")


def component_specs(spark, sf):
    found = specs.observation_specs(tables(spark, sf).nodes(), 2, True)
    return found.select(
        "graph_idx", "component_id", "query_entity", "obs_size", joined("observed_entities"), "spec_ord"
    )


def inference_types(spark, sf):
    return tables(spark, sf).builder().specs().select(
        "graph_idx", "spec_ord", joined("inference_types"), "primary_inference_type"
    )


def sample_per_world(spark, sf):
    t = tables(spark, sf)
    b = t.builder()
    return specs.sample_per_world(specs.spec_counts(b.queries()), t.num_worlds(), b.config.sample_ratio_from_worlds, SEED)


def observation_prompts(spark, sf):
    rows = tables(spark, sf).builder().observation_rows()
    return examples.render_observations(rows).select("row_key", "prompt")


def observation_examples(spark, sf):
    return flat(examples.render_observations(tables(spark, sf).builder().observation_rows()))


def _seen(spark, sf):
    return tables(spark, sf).builder().observed().withColumn("split", F.lit("train"))


def conditional_probability(spark, sf):
    found = tables(spark, sf).builder().by_size(_seen(spark, sf), caps.conditional_probability)
    return found.select(
        "graph_idx", "query_entity", joined("observed_entities"), joined("observed_values"), "answer",
        "value_count", "condition_count", F.round("probability", 9).alias("probability"),
    )


def probability_bins(spark, sf):
    return tables(spark, sf).builder().by_size(_seen(spark, sf), caps.probability_bins).select(
        "graph_idx", "world_id", "spec_ord", "probability_bin"
    )


# explanations


def _single(spark, sf, family, limit=10):
    t = tables(spark, sf)
    b = t.builder()
    linked = graph.adjacency(t.nodes(), t.edges())
    sources = {
        "rule": lambda: examples.rule_answers(linked),
        "parent_retrieval": lambda: examples.neighbour_answers(linked, "parents"),
        "child_retrieval": lambda: examples.neighbour_answers(linked, "children"),
    }
    rows = examples.single_explanations(sources[family](), b.splits(), family, limit)
    return flat(examples.render_explanations(rows))


def rule_explanations(spark, sf):
    return _single(spark, sf, "rule", 11)


def parent_retrieval(spark, sf):
    return _single(spark, sf, "parent_retrieval")


def child_retrieval(spark, sf):
    return _single(spark, sf, "child_retrieval")


def relationship_explanations(spark, sf):
    t = tables(spark, sf)
    b = t.builder()
    rows = examples.relationship_explanations(t.nodes(), b.related(), b.splits(), 10)
    return flat(examples.render_explanations(rows))


def explanation_prompts(spark, sf):
    return examples.render_explanations(tables(spark, sf).builder().explanation_rows()).select(
        "row_key", "prompt"
    )


def explanation_copies(spark, sf):
    rows = tables(spark, sf).builder().explanation_rows()
    return examples.train_explanation_copies(rows, 2).select("row_key", "split", "explanation_type")


# instructions


def _instructions(spark, sf):
    return star.instructions(spark, sf)


def instruction_first_n(spark, sf):
    return examples.first_rows(_instructions(spark, sf), ["conv_id", "turn"], 100)


def instruction_boxing(spark, sf):
    return _instructions(spark, sf).select(
        "conv_id", "turn", text.instruction_answer(F.col("output")).alias("answer")
    )


def instruction_examples(spark, sf):
    return flat(examples.instruction_rows(_instructions(spark, sf), ["conv_id", "turn"], 2500))


# caps


def cap_by_key(spark, sf):
    lines = star.lines(spark, sf).select("split", "key", "row_key")
    return caps.cap_by_key(lines, KEY_CAP, ["split", "key"], "row_key", SEED).select("split", "key", "row_key")


def cap_multilabel(spark, sf):
    lines = star.lines(spark, sf).select("split", "inference_types", "row_key")
    return caps.cap_multilabel(lines, LABEL_CAP, "row_key", SEED).select(
        "split", joined("inference_types"), "row_key"
    )


def cap_component_bin(spark, sf):
    rows = tables(spark, sf).builder(**COMPONENT).bin_capped()
    return rows.select("graph_idx", "component_id", "row_key", "answer")


def cap_pipeline(spark, sf):
    observations, explanations = tables(spark, sf).builder(**COMPONENT).capped()
    return observations.select("split", "kind", "row_key", "answer").unionByName(
        explanations.select("split", "kind", "row_key", "answer")
    )


# data set, sinks and reports


def full_dataset(spark, sf):
    return flat(tables(spark, sf).builder().examples())


def _written(spark, sf):
    t = tables(spark, sf)

    def make():
        path = scratch_path(spark, "examples")
        jsonl.write_splits(t.examples(), path)
        return path

    return t.once("jsonl", make)


def scan_examples(spark, sf):
    return flat(jsonl.scan_examples(spark, _written(spark, sf)))


def jsonl_roundtrip(spark, sf):
    path = scratch_path(spark, "roundtrip")
    jsonl.write_splits(tables(spark, sf).examples(), path)
    return jsonl.scan_examples(spark, path).groupBy("split", "kind").agg(
        ranking.hashed_count().alias("n"),
        F.sum(F.length("prompt")).alias("prompt_chars"),
        F.sum(F.length("completion")).alias("completion_chars"),
        F.sum(F.size("observed_entities")).cast("bigint").alias("observed"),
        F.count("explanation_type").alias("typed"),
        F.min("prompt").alias("first_prompt"),
        F.max("prompt").alias("last_prompt"),
    )


def metadata_summary(spark, sf):
    t = tables(spark, sf)
    b = t.builder()
    path = scratch_path(spark, "metadata")
    metadata.write_metadata(metadata.metadata_record(t.examples(), b.metadata()), b.splits(), path)
    record, owners = metadata.read_metadata(spark, path)

    def entries(name):
        return record.select(F.lit(name).alias("name"), F.explode(name).alias("key", "value"))

    held = owners.groupBy(F.col("split").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    names = [c for c in record.columns if not c.endswith("_counts")]
    pairs = [F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names]
    plain = record.select(F.lit("parameter").alias("name"), F.inline(F.array(*pairs)))
    counted = (
        entries("split_counts")
        .unionByName(entries("kind_counts"))
        .unionByName(held.select(F.lit("explanation_split_by_entity").alias("name"), "key", "value"))
    )
    return counted.withColumn("value", F.col("value").cast("string")).unionByName(plain)


def split_kind_counts(spark, sf):
    return report.split_kind_counts(tables(spark, sf).examples())


def observation_type_counts(spark, sf):
    return report.observation_type_counts(tables(spark, sf).examples())


def explanation_type_counts(spark, sf):
    return report.explanation_type_counts(tables(spark, sf).examples())


def relationship_truth_counts(spark, sf):
    return report.relationship_truth_counts(tables(spark, sf).examples())


def truth_counts_grouping_sets(spark, sf):
    return report.truth_counts(tables(spark, sf).examples())


def type_distribution_rollup(spark, sf):
    return report.type_distribution(tables(spark, sf).examples())


def distinct_types(spark, sf):
    return report.distinct_types(tables(spark, sf).examples())


def count_rendering(spark, sf):
    return report.split_breakdown(tables(spark, sf).examples())


def first_example_per_type(spark, sf):
    return report.first_example_per_type(tables(spark, sf).examples())


def split_preview(spark, sf):
    return report.split_preview(tables(spark, sf).examples())


def eval_split_fanout(spark, sf):
    val = tables(spark, sf).examples().filter(F.col("split") == "val")
    return report.eval_split_fanout(val).select("eval_split", "row_key", "explanation_type")


def example_index(spark, sf):
    rows = star.lines(spark, sf).select("split", "row_key")
    return report.example_index(rows, ["row_key"]).select("split", "row_key", "example_id")


def seeded_shuffle(spark, sf):
    rows = star.lines(spark, sf).select("row_key")
    return report.seeded_shuffle(rows, "row_key", SEED).select("row_key", "position")


def stride_sample(spark, sf):
    return report.stride_sample(star.lines(spark, sf).select("row_key"), ["row_key"], 2000)


def natural_order(spark, sf):
    called = F.col("c_name")
    name = F.when(F.col("c_nationkey") % 5 == 0, F.concat(called, F.lit("-old"))).otherwise(
        F.regexp_replace(called, "#0+", "-")
    )
    names = star.table(spark, sf, "customer").select(name.alias("name"))
    keyed, order = report.natural_keys(names, "name", "Customer-")
    return ranking.indexed(keyed, order, "position").select("name", "position")


# text


def entity_names(spark, sf):
    position = F.col("p_partkey") % text.NAME_COUNT
    return star.table(spark, sf, "part").select("p_partkey", text.entity_name(position).alias("name"))


def boxed_wrap(spark, sf):
    return star.table(spark, sf, "orders").select(
        "o_orderkey", text.boxed(F.col("o_orderstatus")).alias("completion")
    )


def metric_slug(spark, sf):
    part = star.table(spark, sf, "part")
    label = F.concat("p_type", F.lit(" / "), "p_brand", F.lit(" (new)"))
    return part.select("p_partkey", text.metric_slug(label).alias("slug"))


def _turns(spark, sf):
    """User turns with reply and the conversation's system text."""
    system = star.table(spark, sf, "conversations").filter("role = 'system' AND turn = 0").select(
        "conv_id", F.col("text").alias("system")
    )
    return _instructions(spark, sf).join(system, "conv_id", "left")


def chat_render(spark, sf):
    user, reply, system = F.col("instruction"), F.col("output"), F.col("system")
    return _turns(spark, sf).select(
        "conv_id", "turn",
        text.chat_text(user, system=system, open_assistant=True).alias("prompt"),
        text.chat_text(user, reply, system).alias("full_text"),
    )


def chat_completion_suffix(spark, sf):
    return chat_render(spark, sf).select(
        "conv_id", "turn", text.completion_suffix(F.col("full_text"), F.col("prompt")).alias("completion")
    )


def length_stats(spark, sf):
    return report.length_stats(_instructions(spark, sf), "instruction", "output").withColumn("avg_len", F.round("avg_len", 6))


def batch_prompt_lengths(spark, sf):
    return report.batch_prompt_lengths(
        _instructions(spark, sf), ["conv_id", "turn"], 32, "instruction"
    ).withColumn("mean_len", F.round("mean_len", 6))


def _vocabulary(spark):
    import public_tokenizers

    return tokens.token_lengths(spark, public_tokenizers.path("word_bpe_49k.json"))


def token_length_stats(spark, sf):
    """Lengths in the tokens of a vocabulary."""
    found = report.length_stats(_instructions(spark, sf), "instruction", "output", length=_vocabulary(spark))
    return found.withColumn("avg_len", F.round("avg_len", 6))


def token_overflow(spark, sf):
    return report.prompt_overflow(_instructions(spark, sf), 60, "instruction", length=_vocabulary(spark)).select(
        "conv_id", "turn", "prompt_len"
    )


def prompt_overflow(spark, sf):
    return report.prompt_overflow(_instructions(spark, sf), 20, "instruction").select(
        "conv_id", "turn", "prompt_len"
    )


# scoring


def _scored(spark, sf):
    ordered = score.columns_to_rows(star.generations(spark, sf))
    return score.score_samples(ordered)


def _example_scores(spark, sf):
    return score.example_accuracy(score.score_samples(star.samples(spark, sf)))


def columns_to_rows(spark, sf):
    return score.columns_to_rows(star.generations(spark, sf)).select("example_id", "sample_idx", "generated_text")


def boxed_extract_last(spark, sf):
    return star.samples(spark, sf).select(
        "row_key", answers.last_boxed(F.col("generated_text")).alias("prediction")
    )


def _stated(spark, sf):
    """Answers in many wordings, one per line item."""
    form = F.col("_form")
    one, two = F.col("supplier").cast("string"), F.col("key")
    wording = (
        F.when(form == 0, F.concat(F.lit("Option ("), F.col("split"), F.lit(").")))
        .when(form == 1, F.concat(F.lit("("), F.col("split"), F.lit(")")))
        .when(form == 2, F.concat(F.lit("  YES"), F.lit(". )")))
        .when(form == 3, F.concat(F.lit("S"), one, F.lit("  and\t"), two, F.lit(" are independent.")))
        .when(form == 4, F.concat(F.lit("There is no relation between "), two, F.lit(" and S"), one, F.lit(" .")))
        .when(form == 5, F.concat(F.lit("S"), one, F.lit(" is an ancestor of "), two))
        .when(form == 6, F.concat(two, F.lit("\n and "), two, F.lit(" Are Independent")))
        .otherwise(F.concat(F.lit("no"), two))
    )
    formed = star.lines(spark, sf).withColumn("_form", draw(SEED, "wording", "row_key") % 8)
    return formed.select("row_key", wording.alias("answer"))


def canonicalize_answers(spark, sf):
    return score.canonical_answers(_stated(spark, sf), "answer", "canonical").select("row_key", "canonical")


def example_accuracy(spark, sf):
    return _example_scores(spark, sf).withColumn("accuracy", F.round("accuracy", 9))


def pass_at_k(spark, sf):
    return score.pass_at_k_table(_example_scores(spark, sf), MAX_K).withColumn(
        "pass_at_k", F.round("pass_at_k", 9)
    )


def accuracy_by_type(spark, sf):
    return score.accuracy_by_type(_example_scores(spark, sf)).withColumn("accuracy", F.round("accuracy", 9))


def scorecard(spark, sf):
    return score.scorecard(_example_scores(spark, sf), MAX_K).withColumn("value", F.round("value", 9))


def prediction_report(spark, sf):
    made = score.prediction_report(_scored(spark, sf), 3)
    shown = F.transform("predictions", lambda p: F.coalesce(p, F.lit("none")))
    canon = F.transform("canonicalized_predictions", lambda p: F.coalesce(p, F.lit("none")))
    return made.select(
        "example_id", "prompt", "answer", "canonical_answer", "primary_inference_type", joined("inference_types"),
        "explanation_type", "query_entity",
        F.round("accuracy", 9).alias("accuracy"),
        *[F.round(F.try_element_at("pass_at_k", F.lit(k)), 9).alias(f"pass_at_{k}") for k in (1, 2, 3)],
        F.array_join(shown, "|").alias("predictions"),
        F.array_join(canon, "|").alias("canonicalized_predictions"),
        joined("texts"),
    )


def prediction_results(spark, sf):
    """The nested report with metrics that JSON cannot hold, written and read back."""
    accuracy = F.col("accuracy")
    endless = F.when(accuracy == 0, F.lit(float("-inf"))).otherwise(accuracy)
    unknown = F.when(accuracy == 1, F.lit(float("nan"))).otherwise(accuracy)
    made = score.prediction_report(_scored(spark, sf), 3).withColumn(
        "metrics", F.struct(F.array(endless, unknown).alias("bounds"), F.create_map(F.lit(7), F.array(unknown)).alias("by_k"), F.col("predictions").alias("distinct"))
    )
    path = scratch_path(spark, "results")
    jsonl.write_results(made, path, sets=["metrics.distinct"])
    back = jsonl.scan_results(spark, path, made.schema)
    bounds, by_k = F.col("metrics.bounds"), F.try_element_at("metrics.by_k", F.lit("7"))
    return back.select(
        "example_id", "prompt", "query_entity", joined("inference_types"), F.round("accuracy", 9).alias("accuracy"),
        *[F.round(F.try_element_at("pass_at_k", F.lit(str(k))), 9).alias(f"pass_at_{k}") for k in (1, 2, 3)],
        F.array_join(F.transform("predictions", lambda p: F.coalesce(p, F.lit("none"))), "|").alias("predictions"), joined("texts"),
        F.array_join(F.array_compact("metrics.distinct"), "|").alias("distinct_predictions"),
        F.round(bounds[0], 9).alias("low"), F.round(bounds[1], 9).alias("high"), F.round(by_k[0], 9).alias("by_7"),
    )


def model_compare(spark, sf):
    scored = score.score_samples(star.samples(spark, sf))
    first = chance(0.5, draw(SEED, "model", "row_key"))
    return score.compare_models(
        score.example_accuracy(scored.filter(first)), score.example_accuracy(scored.filter(~first)), ("a", "b")
    )


def eval_subset(spark, sf):
    orders = star.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("example_id"), F.col("o_orderstatus").alias("answer")
    )
    return report.eval_subset(orders, 1000, "example_id", SEED)


def json_safe_metrics(spark, sf):
    value = (
        F.when(F.col("l_discount") == 0, F.lit(float("inf")))
        .when(F.col("l_tax") == 0, F.lit(float("nan")))
        .when(F.col("l_tax") == 0.01, F.lit(float("-inf")))
        .otherwise(F.col("l_quantity"))
    )
    path = scratch_path(spark, "metrics")
    lines = star.table(spark, sf, "lineitem").select(
        star.line_key().alias("row_key"), text.json_safe(value).alias("value")
    )
    jsonl.write_results(lines, path)
    return spark.read.schema("row_key string, value double").json(path)


ALL = [
    candidate_edges, bernoulli_rows, root_nodes, assign_rules, adjacency, reachability, ancestor_counts,
    descendant_counts, pair_relations, weak_components, node_levels, level_widths, root_facts,
    rule_propagation, unresolved_nodes, split_exact, split_by_graph, split_by_node, explanation_split,
    entity_split_counts, observation_specs, component_specs, inference_types, sample_per_world,
    observation_prompts, observation_examples, conditional_probability, probability_bins,
    rule_explanations, parent_retrieval, child_retrieval, relationship_explanations, explanation_prompts,
    explanation_copies, instruction_first_n, instruction_boxing, instruction_examples, cap_by_key,
    cap_multilabel, cap_component_bin, cap_pipeline, full_dataset, scan_examples, jsonl_roundtrip,
    metadata_summary, split_kind_counts, observation_type_counts, explanation_type_counts,
    relationship_truth_counts, truth_counts_grouping_sets, type_distribution_rollup, distinct_types,
    count_rendering, first_example_per_type, split_preview, eval_split_fanout, example_index,
    seeded_shuffle, stride_sample, natural_order, entity_names, boxed_wrap, metric_slug, chat_render,
    chat_completion_suffix, length_stats, batch_prompt_lengths, prompt_overflow, token_length_stats, token_overflow, columns_to_rows,
    boxed_extract_last, canonicalize_answers, example_accuracy, pass_at_k, accuracy_by_type, scorecard,
    prediction_report, prediction_results, model_compare, eval_subset, json_safe_metrics,
]


def queries() -> dict:
    return {query.__name__: query for query in ALL}
