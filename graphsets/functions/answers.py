"""Reading, normalising and scoring generated answers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsets.functions.text import WHITESPACE

# Fixed value: a box with up to two further levels of braces. Possessive, so
# that long texts neither backtrack nor overflow the stack.
BOX_PATTERN = r"(?s)\\boxed\{((?:[^{}]++|\{(?:[^{}]++|\{[^{}]*\})*\})*+)\}"
# The answer forms that count as equal.
OPTION_FORM = r"^(?:option\s*)?\(?([abcde])\)?[).:]?$"
INDEPENDENT_FORM = r"^(\S+)\s+and\s+(\S+)\s+are independent$"
NO_RELATION_FORM = r"^there is no relation between\s+(\S+)\s+and\s+(\S+)$"
TRAILING = ". )"


def last_boxed(text: Column) -> Column:
    """Content of the last box, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(BOX_PATTERN), 1), F.lit(-1))


def collapse_whitespace(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, WHITESPACE, " "))


def canonical_ascii(answer: Column) -> Column:
    """Normal form of an answer whose characters are already in NFKC form."""
    norm = collapse_whitespace(answer)
    lowered = F.btrim(F.lower(norm))
    bare = F.rtrim(lowered, F.lit(TRAILING))

    def unordered(pattern):
        one = F.regexp_extract(bare, pattern, 1)
        two = F.regexp_extract(bare, pattern, 2)
        return F.concat(
            F.least(one, two), F.lit(" and "), F.greatest(one, two), F.lit(" are independent")
        )

    return (
        F.when(lowered.rlike(OPTION_FORM), F.regexp_extract(lowered, OPTION_FORM, 1))
        .when(bare.isin("yes", "no"), bare)
        .when(bare.rlike(INDEPENDENT_FORM), unordered(INDEPENDENT_FORM))
        .when(bare.rlike(NO_RELATION_FORM), unordered(NO_RELATION_FORM))
        .otherwise(norm)
    )


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark SQL has no function for."""
    if text.isna().all():
        return text
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normal_form(text: Column) -> Column:
    """NFKC in one pass: Python gets nulls in place of the ASCII texts it cannot change."""
    other = F.when(F.octet_length(text) != F.char_length(text), text)
    return F.coalesce(nfkc(other), text)


def pass_at_k(samples: Column, correct: Column, k: Column) -> Column:
    """Chance that k of the samples, drawn without replacement, hold a correct one.

    It is 1 whenever fewer than k samples are wrong, also if k exceeds the
    number of samples and none is correct.
    """
    wrong = samples - correct
    missed = F.aggregate(
        F.sequence(wrong + 1, samples), F.lit(1.0), lambda acc, i: acc * (1 - k / i)
    )
    return F.when(wrong < k, F.lit(1.0)).when(correct == 0, F.lit(0.0)).otherwise(1 - missed)
