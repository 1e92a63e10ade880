"""Column expressions over names, labels and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsets.functions.templates import ANSWER_MARK, INSTRUCTION_SUFFIX
from graphsets.schema import FALSE_LABEL, TRUE_LABEL, UNKNOWN

LETTERS = 26
NAME_COUNT = LETTERS * LETTERS
# Java's \s with the Unicode flag, plus the four ASCII separators.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def boxed(answer: Column) -> Column:
    return F.concat(F.lit("\\boxed{"), answer, F.lit("}"))


def entity_name(position: Column) -> Column:
    """Two-letter name AA, AB, … ZZ for a 0-based position; an error beyond ZZ."""
    name = F.concat(
        F.chr(F.lit(65) + F.floor(position / LETTERS)), F.chr(F.lit(65) + position % LETTERS)
    )
    problem = F.concat(
        F.lit(f"only {NAME_COUNT} two-letter names exist, asked for position "),
        position.cast("string"),
    )
    return F.when((position >= 0) & (position < NAME_COUNT), name).otherwise(
        F.raise_error(problem).cast("string")
    )


def entity_names(spark: SparkSession, count: int) -> DataFrame:
    """The first ``count`` names in order."""
    if not 0 <= count <= NAME_COUNT:
        raise ValueError(f"only {NAME_COUNT} two-letter names exist, asked for {count}")
    return spark.range(count).select(
        F.col("id").alias("position"), entity_name(F.col("id")).alias("entity")
    )


def truth_label(value: Column) -> Column:
    return F.when(value, F.lit(TRUE_LABEL)).otherwise(F.lit(FALSE_LABEL))


def or_unknown(value: Column) -> Column:
    """Null and empty both become ``unknown``."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(UNKNOWN))


def metric_slug(value: Column) -> Column:
    """Lower case, each run of other characters one underscore, none at the ends."""
    dashed = F.regexp_replace(F.lower(or_unknown(value)), r"[^\p{L}\p{N}]+", "_")
    return or_unknown(F.btrim(dashed, F.lit("_")))


def instruction_prompt(instruction: Column) -> Column:
    return F.concat(instruction, F.lit(INSTRUCTION_SUFFIX))


def instruction_answer(output: Column) -> Column:
    """Box what follows the last answer mark, without dots at its ends."""
    pattern = f"(?s)^(.*{ANSWER_MARK})(.*)$"
    head = F.regexp_extract(output, pattern, 1)
    tail = F.btrim(F.regexp_extract(output, pattern, 2), F.lit("."))
    return F.when(
        output.contains(ANSWER_MARK), F.concat(head, boxed(tail), F.lit("."))
    ).otherwise(output)


def relation_text(relation: Column, first: Column, second: Column) -> Column:
    """The sentence that states the relation of an ordered pair."""
    return (
        F.when(relation == "ancestor", F.concat(first, F.lit(" is an ancestor of "), second))
        .when(relation == "descendant", F.concat(first, F.lit(" is a descendant of "), second))
        .otherwise(F.concat(first, F.lit(" and "), second, F.lit(" are independent")))
    )


def relation_answer_type(answer: Column) -> Column:
    """Relation named by a sentence, tested in this order."""
    return (
        F.when(answer.contains(" is an ancestor of "), "ancestor")
        .when(answer.contains(" is a descendant of "), "descendant")
        .when(answer.contains(" are independent"), "independent")
        .otherwise(UNKNOWN)
    )


def token_count(text: Column) -> Column:
    """Whitespace-separated words; the default length of the length reports."""
    words = F.btrim(F.regexp_replace(text, WHITESPACE, " "))
    gaps = F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(words == "", F.lit(0)).otherwise(gaps + 1).cast("bigint")


# The default chat markup (ChatML).
CHAT_OPEN = "<|im_start|>"
CHAT_CLOSE = "<|im_end|>\n"


def chat_header(role: str) -> Column:
    return F.lit(f"{CHAT_OPEN}{role}\n")


def chat_message(role: str, content: Column) -> Column:
    return F.concat(chat_header(role), content, F.lit(CHAT_CLOSE))


def chat_text(
    user: Column,
    assistant: Column | None = None,
    system: Column | None = None,
    open_assistant: bool = False,
    raw: bool = False,
    message=chat_message,
    header=None,
) -> Column:
    """Messages in order: optional system, user, optional assistant.

    ``message(role, content)`` is the markup, and ``header(role)`` its part before the
    content, which an open assistant turn ends with. With ``raw``, or where the markup
    gives null, the user's prompt is passed on as it is.
    """
    if raw:
        return user
    if header is None:
        if open_assistant and message is not chat_message:
            raise ValueError("an open turn in another markup needs its header")
        header = chat_header
    parts = [message("user", user)]
    if system is not None:
        empty = F.coalesce(system, F.lit("")) == ""
        parts.insert(0, F.when(empty, F.lit("")).otherwise(message("system", system)))
    if assistant is not None:
        parts.append(message("assistant", assistant))
    if open_assistant:
        parts.append(header("assistant"))
    return F.coalesce(F.concat(*parts), user)


def completion_suffix(full: Column, prompt: Column) -> Column:
    """What follows the prompt's length in the full text."""
    return F.substr(full, F.length(prompt) + 1)


def json_safe(value: Column) -> Column:
    """NaN and both infinities become null."""
    endless = (value == float("inf")) | (value == float("-inf"))
    return F.when(F.isnan(value) | endless, None).otherwise(value)


def text_keys(mapping: Column) -> Column:
    """A map whose keys are strings, as JSON needs."""
    return F.transform_keys(mapping, lambda k, _: k.cast("string"))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))
