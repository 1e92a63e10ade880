"""Record layouts shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels and record fields of the data format.
TRUE_LABEL = "1"
FALSE_LABEL = "0"
SPLITS = ("train", "val", "test")
INFERENCE_PRIORITY = ("ancestor", "descendant", "independent")
EXPLANATION_TYPES = ("rule", "parent_retrieval", "child_retrieval", "relationship")
EXPLANATION_LABEL = "rule_explanation"
INSTRUCTION_LABEL = "instruct"
UNKNOWN = "unknown"

EXAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("answer", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField("explanation_type", T.StringType()),
        T.StructField("graph_idx", T.LongType()),
        T.StructField("inference_types", T.ArrayType(T.StringType())),
        T.StructField("kind", T.StringType()),
        T.StructField("observed_entities", T.ArrayType(T.StringType())),
        T.StructField("observed_values", T.ArrayType(T.StringType())),
        T.StructField("primary_inference_type", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("query_entity", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)
EXAMPLE_COLUMNS = EXAMPLE_SCHEMA.fieldNames()

GENERATION_SCHEMA = T.StructType(
    [
        T.StructField("example_id", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("query_entity", T.StringType()),
        T.StructField("primary_inference_type", T.StringType()),
        T.StructField("explanation_type", T.StringType()),
        T.StructField("generated_text", T.ArrayType(T.StringType())),
        T.StructField("token_ids", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("num_graphs", T.LongType()),
        T.StructField("num_entities", T.LongType()),
        T.StructField("edge_prob", T.DoubleType()),
        T.StructField("node_or_prob", T.DoubleType()),
        T.StructField("num_worlds", T.LongType()),
        T.StructField("sample_ratio_from_worlds", T.DoubleType()),
        T.StructField("root_prior", T.DoubleType()),
        T.StructField("max_obs_size", T.LongType()),
        T.StructField("max_observations", T.LongType()),
        T.StructField("max_observations_unit", T.StringType()),
        T.StructField("max_observations_per_component_probability_bin", T.LongType()),
        T.StructField("max_observations_per_component_probability_bin_unit", T.StringType()),
        T.StructField("max_explanations", T.LongType()),
        T.StructField("max_explanations_unit", T.StringType()),
        T.StructField("num_copies_explanations", T.LongType()),
        T.StructField("add_instruction_datapoints", T.LongType()),
        T.StructField("heldout_scope", T.StringType()),
        T.StructField("per_component_data", T.BooleanType()),
        T.StructField("split_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("kind_counts", T.MapType(T.StringType(), T.LongType())),
    ]
)
