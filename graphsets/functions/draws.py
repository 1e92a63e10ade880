"""Seeded draws that depend only on row keys.

A draw is the leading 60 bits of an md5 over ``seed|purpose|key…``. It does not
depend on partitioning, task order or retries, and other engines can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60
BUCKET_BITS = 12


def draw(seed: int, purpose: str, *keys) -> Column:
    """Uniform bigint in [0, 2**60) for the (non-null) keys."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def chance(probability: float, drawn: Column) -> Column:
    """Independent yes/no per row, yes with the given probability."""
    return drawn < F.lit(int(probability * (1 << DRAW_BITS))).cast("bigint")


def draw_bucket(drawn: Column) -> Column:
    """Leading bits of a draw: 4096 even, order-keeping buckets."""
    return F.shiftright(drawn, DRAW_BITS - BUCKET_BITS)
