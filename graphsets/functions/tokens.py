"""Lengths of texts in the tokens of a given vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BATCH = 1024  # texts that are encoded at once


@cache
def _tokenizer(vocabulary: bytes):
    """One tokenizer for each worker and vocabulary."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(vocabulary.decode())
    made.no_truncation()
    made.no_padding()
    return made


def token_lengths(spark: SparkSession, path: str, special: bool = False) -> Callable[[Column], Column]:
    """A length function for the reports: how many tokens the vocabulary file at ``path`` makes of a text.

    The file (the JSON of the tokenizers library, a few MB) is read by Spark, so it may lie
    where only Spark reads, and is sent to the workers once. ``special`` adds the
    tokens that the vocabulary puts around a text. Null texts have null length.
    """
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one file
    sent = spark.sparkContext.broadcast(bytes(rows[0]["content"]))

    @F.arrow_udf("bigint")
    def length(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(sent.value)
        for texts in parts:
            sizes: list[int | None] = []
            for start in range(0, len(texts), BATCH):
                some = texts.slice(start, BATCH).to_pylist()
                found = iter(tokenizer.encode_batch_fast([t for t in some if t is not None], add_special_tokens=special))
                sizes += [None if t is None else len(next(found).ids) for t in some]
            yield pa.array(sizes, pa.int64())

    return length
