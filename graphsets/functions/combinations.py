"""Sets of positions as numbers: the combinatorial number system in Column expressions.

Sets of one size out of ``count`` positions are numbered from 0 in the order of their
rising positions. Written from the last position down, the number from the end is a sum of
binomials, so a set is ranked and unranked without a list of sets.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choose(count: Column, size: int) -> Column:
    """Number of sets of ``size`` out of ``count``, exact; beyond 64 bits it is an error."""
    some = F.greatest(count, F.lit(0)).cast("bigint")
    if size == 0:
        return F.lit(1).cast("bigint")
    if size == 1:
        return some
    if size == 2:
        return F.call_function("div", some * (some - 1), F.lit(2).cast("bigint"))
    sets = F.lit(1).cast("decimal(38,0)")
    for i in range(size):
        factor = F.greatest(count - i, F.lit(0)).cast("decimal(18,0)")
        sets = F.call_function("div", (sets * factor).cast("decimal(38,0)"), F.lit(i + 1).cast("decimal(38,0)"))
        sets = sets.cast("decimal(38,0)")
    return sets.cast("bigint")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with value computed once and not copied to each place where it is used."""
    return F.transform(F.array(value), use)[0]


def _guessed(total: Column, size: int) -> Column:
    """The root of ``size! * total``, which is about the largest d with choose(d, size) <= total."""
    root = F.pow(total.cast("double") * factorial(size), F.lit(1.0 / size))
    return F.floor(root + (size - 1) / 2).cast("bigint")


def _exactly(total: Column, guess: Column, size: int) -> Column:
    near = [guess + step for step in range(-2, (size + 1) // 2 + 2)]
    return F.greatest(F.lit(size - 1).cast("bigint"), *[F.when(choose(d, size) <= total, d) for d in near])


def largest(total: Column, size: int) -> Column:
    """The largest d with choose(d, size) <= total.

    The root of ``size! * total`` is off by at most (size + 1) / 2 and the rounding of a
    double, and the few numbers around it are tried exactly.
    """
    if size == 1:
        return total
    guess = _guessed(total, size)
    return _exactly(total, guess, size) if size == 2 else _bound(guess, lambda near: _exactly(total, near, size))


def set_rank(positions: list[Column], count: Column) -> Column:
    """The number of a set given by its rising positions."""
    size = len(positions)
    after = sum((choose(count - 1 - p, size - i) for i, p in enumerate(positions)), F.lit(0).cast("bigint"))
    return choose(count, size) - 1 - after


def unrank_sets(df: DataFrame, rank: Column, count: str, size: str, most: int, out: str) -> DataFrame:
    """Add the rising positions of the set numbered ``rank`` among those of ``size`` (1 to ``most``) out of ``count``.

    For up to two positions all is plain arithmetic. For more, values are bound, as the
    optimizer would copy each into all its uses, and these into theirs.
    """
    sets = F.when(F.col(size) == 1, choose(F.col(count), 1))
    for k in range(2, most + 1):
        sets = sets.when(F.col(size) == k, choose(F.col(count), k))

    def bound(rest: Column, k: int) -> Column:
        taken = F.col(size) >= k

        def rest_of(r: Column) -> Column:
            def with_digit(d: Column) -> Column:
                after = F.when(taken, r - choose(d, k)).otherwise(r)
                return F.array(d) if k == 1 else F.concat(F.array(d), bound(after, k - 1))

            return _bound(F.when(taken, largest(r, k)), with_digit)

        return _bound(rest, rest_of)

    df = df.withColumn("_rest", sets - 1 - rank)
    if most > 2:
        positions = F.transform(F.array_compact(bound(F.col("_rest"), most)), lambda d: F.col(count) - 1 - d)
        return df.withColumn(out, positions).drop("_rest")
    # A column for each step and one array a size: Spark would copy each step into all its uses, and
    # interpret what is given to functions of lambdas.
    names = [f"_digit{k}" for k in range(most, 0, -1)]
    for k, name in zip(range(most, 0, -1), names):
        taken = F.col(size) >= k
        if k == 1:
            df = df.withColumn(name, F.when(taken, F.col("_rest")))
            continue
        df = df.withColumn("_guess", F.when(taken, _guessed(F.col("_rest"), k)))
        df = df.withColumn(name, F.when(taken, _exactly(F.col("_rest"), F.col("_guess"), k)))
        df = df.withColumn("_rest", F.when(taken, F.col("_rest") - choose(F.col(name), k)).otherwise(F.col("_rest")))
    df = df.withColumns({name: F.col(count) - 1 - F.col(name) for name in names}).drop("_guess")
    found = F.array().cast("array<bigint>")
    for k in range(1, most + 1):
        found = F.when(F.col(size) == k, F.array(*names[most - k:])).otherwise(found)
    return df.withColumn(out, found).drop("_rest", *names)
