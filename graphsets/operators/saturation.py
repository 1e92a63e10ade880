"""Where the labels of a greedy scan fill up, from counts.

In draw order a row is kept while each of its labels is below a cap. When one label fills
up, the rows that carry it stop counting for the others, so the points depend on each
other. They are not looked for one by one: counts per label set and interval of draws
bracket all of them at once. Only the intervals in which a label may fill are cut into
finer ones, and of the last ones the rows are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsets.functions.draws import BUCKET_BITS, DRAW_BITS
from graphsets.operators.ranking import lowest
from graphsets.session import Rounds, durable

FINE_ROWS = 1_000_000  # rows of open intervals that are taken one by one
ROW = -1  # the width of a cell that is one row


def _segments(cells: pd.DataFrame) -> Iterator[tuple[int, int, str | None, list[tuple[tuple[str, ...], int]]]]:
    """(begin, width, key, [(labels, rows)]) of each interval or row, in draw order."""
    held: tuple[int, int, str | None] | None = None
    rows: list[tuple[tuple[str, ...], int]] = []
    # An interval never overlaps rows; ties of draws go by key.
    ordered = cells.assign(k=cells["k"].fillna("")).sort_values(["begin", "k"], kind="stable")
    for begin, width, key, labels, n in zip(*(ordered[c] for c in ("begin", "width", "k", "labels", "n")), strict=True):
        if held != (begin, width, key):
            if held is not None:
                yield *held, rows
            held, rows = (begin, width, key), []
        rows.append((tuple(labels), int(n)))
    if held is not None:
        yield *held, rows


def bracketed(cells: pd.DataFrame, cap: int) -> tuple[list[int], list[tuple[str, int, str]]]:
    """(begins of intervals in which kept rows are uncertain, (label, draw, key) of labels that surely fill at a row).

    Each label has a least and a greatest count. It is full once the least reaches the
    cap, and may be full from where the greatest does.
    """
    least: dict[str, int] = {}
    most: dict[str, int] = {}
    full: set[str] = set()
    maybe: set[str] = set()
    unsure: list[int] = []
    points: list[tuple[str, int, str]] = []
    for begin, width, key, rows in _segments(cells):
        live = [(labels, n) for labels, n in rows if full.isdisjoint(labels)]
        added: dict[str, int] = {}
        for labels, n in live:
            for label in labels:
                added[label] = added.get(label, 0) + n
        if width == ROW:
            risky = maybe.intersection(added)
        else:
            risky = {x for x, n in added.items() if x in maybe or most.get(x, 0) + n >= cap}
            if risky:
                unsure.append(begin)
        for labels, n in live:
            danger = risky.intersection(labels)
            for label in labels:
                most[label] = min(cap, most.get(label, 0) + n)
                # Rows with no other label in danger are kept until this one is full.
                if danger <= {label}:
                    least[label] = min(cap, least.get(label, 0) + n)
        for label in added:
            if label in full:
                continue
            if least.get(label, 0) >= cap:
                full.add(label)
                maybe.discard(label)
                if width == ROW:
                    points.append((label, begin, key))
            elif most[label] >= cap:
                maybe.add(label)
    return unsure, points


def saturation_points(
    df: DataFrame, cap: int, split: str, labels: str, drawn: str, row_key: str
) -> DataFrame:
    """(split, label, at): the draw and key at which a label's count reaches ``cap``; labels that stay below have no row.

    Rows of one label set are kept as a prefix, so ``cap`` rows per set decide. The counts
    of a split, one for each label set and interval, are walked in one task. The number of
    jobs does not depend on the labels: each cut divides the open intervals by 4,096, and
    once their rows are few they are taken one by one.
    """
    # Only the draws and labels are read twice, not the rows they came from.
    narrow = durable(
        df.select(
            F.col(split).alias("split"), F.array_sort(labels).alias("labels"), F.col(drawn).alias("d"), F.col(row_key).cast("string").alias("k"),
        ).withColumn("_set", F.to_json("labels"))
    )
    if not narrow.groupBy("k").count().filter(F.col("count") > 1).isEmpty():
        raise ValueError(f"{row_key} must name each row once")
    live = durable(lowest(narrow, ["split", "_set"], "d", ["k"], cap).drop("_set"))
    rounds = Rounds()

    def begin(width: int) -> Column:
        return F.shiftleft(F.shiftright("d", width), width)

    def counted(rows: DataFrame, width: int) -> DataFrame:
        cells = rows.groupBy("split", "labels", begin(width).alias("begin")).agg(F.count(F.lit(1)).alias("n"))
        return cells.select("split", "labels", "begin", F.lit(width).alias("width"), F.lit(None).cast("string").alias("k"), "n")

    def walked(cells: DataFrame, schema: str, pick: int) -> DataFrame:
        def walk(group: tuple, of_split: pd.DataFrame) -> pd.DataFrame:
            found = bracketed(of_split, cap)[pick]
            rows = [(group[0], *(x if isinstance(x, tuple) else (x,))) for x in found]
            return pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")])

        return cells.groupBy("split").applyInPandas(walk, schema)

    width = DRAW_BITS - BUCKET_BITS
    cells, rest = rounds.write(counted(live, width)), live
    while True:
        # A label is unsure in few intervals, so their number follows the labels.
        unsure = rounds.write(walked(cells, "split string, begin long", 0))
        inside = rest.withColumn("begin", begin(width)).join(unsure, ["split", "begin"], "left_semi").drop("begin")
        rest = rounds.write(inside)
        settled = cells.join(unsure, ["split", "begin"], "left_anti").select(*cells.columns)
        if width < BUCKET_BITS or rest.count() <= FINE_ROWS:
            break
        width -= BUCKET_BITS
        cells = rounds.write(settled.unionByName(counted(rest, width)))
    single = rest.select("split", "labels", F.col("d").alias("begin"), F.lit(ROW).alias("width"), "k", F.lit(1).cast("bigint").alias("n"))
    points = rounds.write(walked(settled.unionByName(single), "split string, label string, d long, k string", 1))
    rounds.keep(points)
    return points.select("split", "label", F.struct("d", "k").alias("at"))
