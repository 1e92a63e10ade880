"""Wordings and answer forms as the checks state them, apart from the code they check."""

from __future__ import annotations

# Wordings of the prompts, by family.
WORDINGS = {
    "observation_single": [
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
    ],
    "observation_multi": [
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
    ],
    "rule": [
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
    ],
    "parent_retrieval": [
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
    ],
    "child_retrieval": [
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
    ],
    "relationship": [
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
    ],
}

# What follows an instruction, and the answer forms that count as equal.
SUFFIX = "\nGive the answer in the format: \\boxed{answer}."
OPTION = r"^(?:option\s*)?\(?([abcde])\)?[).:]?$"
INDEPENDENT = r"^(\S+)\s+and\s+(\S+)\s+are independent$"
NO_RELATION = r"^there is no relation between\s+(\S+)\s+and\s+(\S+)$"
