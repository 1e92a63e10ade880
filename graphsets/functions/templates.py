"""Prompt wordings.

Placeholders: ``{F}`` one fact, ``{A}`` facts joined by " and ", ``{C}`` facts
joined by ", ", ``{Q}`` the query, ``{E}`` an entity, ``{P1}`` and ``{P2}`` a pair.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The prompt wordings of the data format.
OBSERVATION_SINGLE = [
    "Given: {F}. Query: {Q}",
    "Observe {F}. What is {Q}?",
    "{F}. Determine {Q}.",
    "If {F}, then what is {Q}?",
    "Known fact: {F}. What can you infer about {Q}?",
    "Observation: {F}. Predict {Q}.",
    "We know that {F}. Is {Q} true or false?",
    "Context: {F}. What is the value of {Q}?",
    "With {F}, what do we conclude about {Q}?",
    "Premise: {F}. Conclusion for {Q}?",
]
# Wordings.
OBSERVATION_MULTI = [
    "Given: {A}. Query: {Q}",
    "Observe {A}. What is {Q}?",
    "{C}. Determine {Q}.",
    "If {A}, then what is {Q}?",
    "Known facts: {A}. What can you infer about {Q}?",
    "Observations: {C}. Predict {Q}.",
    "We know that {A}. Is {Q} true or false?",
    "Context: {C}. What is the value of {Q}?",
    "With {A}, what do we conclude about {Q}?",
    "Premises: {C}. Conclusion for {Q}?",
]
# Wordings.
RULE = [
    "What is the rule that determines {E}? Express the rule in the format \\boxed{answer}.",
    "How is {E} computed from its inputs? Express the rule in the format \\boxed{answer}.",
    "Describe the logical rule for {E}. Express the rule in the format \\boxed{answer}.",
    "What determines whether {E} is True or False? Express the rule in the format \\boxed{answer}.",
    "Explain how {E} depends on other entities. Express the rule in the format \\boxed{answer}.",
    "State the condition under which {E} becomes True. Express the rule in the format \\boxed{answer}.",
    "What logical expression defines {E}? Express the rule in the format \\boxed{answer}.",
    "Write the update rule for {E}. Express the rule in the format \\boxed{answer}.",
    "How do the direct inputs combine to set {E}? Express the rule in the format \\boxed{answer}.",
    "What input pattern makes {E} true or false? Express the rule in the format \\boxed{answer}.",
]
# Wordings.
PARENT_RETRIEVAL = [
    "What are the direct parents of {E}? Give the entity names in the format \\boxed{answer}.",
    "Which entities directly determine {E}? Give the entity names in the format \\boxed{answer}.",
    "Name the entities that are direct inputs to {E}. Give the entity names in the format \\boxed{answer}.",
    "{E} is directly determined by which entities? Give the entity names in the format \\boxed{answer}.",
    "List the direct parents of {E}. Give the entity names in the format \\boxed{answer}.",
    "Which nodes feed directly into {E}? Give the entity names in the format \\boxed{answer}.",
    "Identify the immediate predecessors of {E}. Give the entity names in the format \\boxed{answer}.",
    "Which entities are one edge upstream of {E}? Give the entity names in the format \\boxed{answer}.",
    "What entities act as the immediate causes of {E}? Give the entity names in the format \\boxed{answer}.",
    "Which entities connect directly into {E}? Give the entity names in the format \\boxed{answer}.",
]
# Wordings.
CHILD_RETRIEVAL = [
    "What are the direct children of {E}? Give the entity names in the format \\boxed{answer}.",
    "Which entities does {E} directly influence? Give the entity names in the format \\boxed{answer}.",
    "Name the entities that {E} is a direct input to. Give the entity names in the format \\boxed{answer}.",
    "{E} directly determines which entities? Give the entity names in the format \\boxed{answer}.",
    "List the direct children of {E}. Give the entity names in the format \\boxed{answer}.",
    "Which nodes are directly downstream of {E}? Give the entity names in the format \\boxed{answer}.",
    "Identify the immediate successors of {E}. Give the entity names in the format \\boxed{answer}.",
    "Which entities receive a direct edge from {E}? Give the entity names in the format \\boxed{answer}.",
    "What entities are immediately affected by {E}? Give the entity names in the format \\boxed{answer}.",
    "Which entities are connected directly out of {E}? Give the entity names in the format \\boxed{answer}.",
]
# Wordings.
RELATIONSHIP = [
    "What is the relationship between {P1} and {P2}? Express the relationship in the format \\boxed{answer}.",
    "How are {P1} and {P2} related? Express the relationship in the format \\boxed{answer}.",
    "Describe the relationship between {P1} and {P2}. Express the relationship in the format \\boxed{answer}.",
    "What dependency exists between {P1} and {P2}? Express the relationship in the format \\boxed{answer}.",
    "Characterize the connection between {P1} and {P2}. Express the relationship in the format \\boxed{answer}.",
    "What kind of dependency links {P1} and {P2}? Express the relationship in the format \\boxed{answer}.",
    "What graph relation holds between {P1} and {P2}? Express the relationship in the format \\boxed{answer}.",
    "State the relationship between {P1} and {P2}. Express the relationship in the format \\boxed{answer}.",
    "Describe how {P1} and {P2} are connected in the graph. Express the relationship in the format \\boxed{answer}.",
    "What does knowing {P1} tell you about {P2}? Express the relationship in the format \\boxed{answer}.",
]
# What follows an instruction, and what its answer begins with.
INSTRUCTION_SUFFIX = "\nGive the answer in the format: \\boxed{answer}."
ANSWER_MARK = "The answer is "

FAMILIES = {
    "observation_single": OBSERVATION_SINGLE,
    "observation_multi": OBSERVATION_MULTI,
    "rule": RULE,
    "parent_retrieval": PARENT_RETRIEVAL,
    "child_retrieval": CHILD_RETRIEVAL,
    "relationship": RELATIONSHIP,
}


def template_table(spark: SparkSession) -> DataFrame:
    """The 60 wordings as (family, template_idx, template)."""
    rows = [
        (family, position, text)
        for family, texts in FAMILIES.items()
        for position, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, "family string, template_idx int, template string")


def fan_out(df: DataFrame, limit: int) -> DataFrame:
    """One row per wording of the row's ``family``; a larger limit stops at the last one.

    The numbers of the wordings are one constant array a family, so nothing is joined.
    """
    numbers = F.lit(None).cast("array<int>")
    for family, texts in FAMILIES.items():
        numbered = F.array(*map(F.lit, range(min(limit, len(texts))))).cast("array<int>")
        numbers = F.when(F.col("family") == family, numbered).otherwise(numbers)
    others = [c for c in df.columns if c != "family"]
    return df.select("family", *others, F.explode(numbers).alias("template_idx"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with its placeholders replaced; nothing is replaced inside inserted texts."""
    parts = [p for p in re.split(r"(\{[A-Z0-9]+\})", template) if p]
    return F.concat(*[values.get(p, F.lit(p)) for p in parts], F.lit(""))


def wording(families: list[str], values: dict[str, Column]) -> Column:
    """The filled wording of the row's ``family`` and ``template_idx``, one concatenation each.

    The wordings are cut while the plan is built, so rows neither join nor parse them.
    """
    chosen = F.lit(None).cast("string")
    for family in families:
        lines = F.lit(None).cast("string")
        for position, text in reversed(list(enumerate(FAMILIES[family]))):
            lines = F.when(F.col("template_idx") == position, fill(text, values)).otherwise(lines)
        chosen = F.when(F.col("family") == family, lines).otherwise(chosen)
    return chosen
