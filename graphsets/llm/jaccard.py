"""Similarity join of texts by the Jaccard similarity of their word shingles.

Texts with the same set of shingles are one class. Classes that agree in a band of
MinHash values are candidates. Within a bucket of a band, a pair's MinHash values are
compared step by step; it is dropped once the posterior probability that it reaches the
threshold falls below the tolerance. What is left is verified on the whole shingle sets.

No pair is written out. A bucket is cut into blocks, each pair of blocks is one group of
bounded size, and a pair belongs to the first band in which its values agree. Groups
yield how many links each member has, and a spanning set of links for the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsets.llm.codes import blocks, flatten, mix, windows, words
from graphsets.llm.store import saved
from graphsets.operators.pairing import hub_join
from graphsets.session import Rounds

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4  # a pair at the threshold is missed with probability (1 - 0.8 ** 4) ** 32, 5e-8
STEP = 16
TOLERANCE = 1e-9
BLOCK = 256
CACHE_SHINGLES = 1 << 14
VERIFIED_SHINGLES = 1 << 16  # about as many are compared with one text at once
BATCH_ROWS = 500  # texts and sets may be long, so few at a time pass between Spark and Python


@cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    numbers = np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)
    drawn = mix(numbers * np.uint64(0xD6E8FEB86659FD93))
    return drawn[: BANDS * ROWS] | np.uint64(1), drawn[BANDS * ROWS :]


@cache
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For each number n of compared values the least number of matches that keeps a pair.

    With a uniform prior and m matches the posterior of the similarity is Beta(m + 1,
    n - m + 1), and the probability of at least ``threshold`` is that of at most m
    successes in n + 1 trials.
    """
    out = []
    for n in range(BANDS * ROWS + 1):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return np.array(out)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a shorter text has one of all its words."""
    text, _, hashes = windows(*words(*flatten(texts)), WIDTH)
    cuts = np.searchsorted(text, np.arange(1, len(texts)))
    return [np.unique(part) for part in np.split(hashes, cuts)]


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values [set, function] of sets that are not empty."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    factors, shifts = _factors()
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= CACHE_SHINGLES):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        work = np.empty_like(flat)
        for f in range(BANDS * ROWS):
            np.multiply(flat, factors[f], out=work)
            np.add(work, shifts[f], out=work)
            out[at:end, f] = np.minimum.reduceat(work, starts) >> np.uint64(32)
        at = end
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band [text, band]."""
    split = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(split.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + split[:, :, row])
    return key


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class key and MinHash values of each text; both null without a word."""
    for rows in batches:
        texts, keys = rows["text"].to_pylist(), rows["name"]
        for first, held in blocks(texts):
            sets = shingle_sets(held)
            some = [i for i, s in enumerate(sets) if len(s)]
            values = minhash([sets[i] for i in some]) if some else np.zeros((0, BANDS * ROWS), np.uint32)
            classes: list[bytes | None] = [None] * len(sets)
            found: list[bytes | None] = [None] * len(sets)
            for i, row in zip(some, values, strict=True):
                classes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                found[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [keys.slice(first, len(held)), pa.array(classes, pa.binary()), pa.array(found, pa.binary())],
                ["name", "class", "values"],
            )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for first, held in blocks(rows["text"].to_pylist()):
            sets = [s.tobytes() for s in shingle_sets(held)]
            yield pa.RecordBatch.from_arrays(
                [rows["class"].slice(first, len(held)), pa.array(sets, pa.binary())], ["class", "shingles"]
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if rows.num_rows:
            values = np.frombuffer(b"".join(rows["values"].to_pylist()), np.uint32).reshape(rows.num_rows, -1)
            keys = band_keys(values).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows["class"].take(pa.array(np.repeat(np.arange(rows.num_rows), BANDS))), pa.array(keys.ravel())],
                ["class", "band"],
            )


def surviving_pairs(left: np.ndarray, right: np.ndarray, own: np.ndarray, same: bool, threshold: float, tolerance: float):
    """Candidate pairs (i, j) of two blocks of MinHash values after Bayesian pruning.

    ``own`` holds the band key of the bucket, so that only pairs whose first common band
    this is are taken; pairs never compare their remaining values once they are dropped.
    """
    least = least_matches(threshold, tolerance)
    left_keys, right_keys = band_keys(left), band_keys(right)
    band = int(np.flatnonzero(left_keys[0] == own)[0])
    found_i, found_j = [], []
    for i in range(len(left)):
        j = np.arange(i + 1 if same else 0, len(right))
        if band:
            j = j[~(right_keys[j, :band] == left_keys[i, :band]).any(axis=1)]
        matches = np.zeros(len(j), np.int64)
        for step in range(0, BANDS * ROWS, STEP):
            if not len(j):
                break
            matches += (right[j, step : step + STEP] == left[i, step : step + STEP]).sum(axis=1)
            keep = matches >= least[step + STEP]
            j, matches = j[keep], matches[keep]
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def _candidates(threshold: float, tolerance: float):
    """Of one group of a bucket: the members with candidates, and the candidate pairs as one row."""

    def group(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = table["class"].to_pylist()
        values = np.frombuffer(b"".join(table["values"].to_pylist()), np.uint32).reshape(len(names), -1)
        side = table["side"].to_numpy()
        band = table["band"][0].as_py()
        own = np.array([band], np.int64).view(np.uint64)[0]
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        first = np.flatnonzero(side == low)
        second = first if low == high else np.flatnonzero(side == high)
        if not len(first) or not len(second):
            i = j = np.zeros(0, np.int64)
        else:
            i, j = surviving_pairs(values[first], values[second], own, low == high, threshold, tolerance)
            i, j = first[i], second[j]
        used = np.unique(np.concatenate([i, j]))
        unit = hashlib.blake2b(f"{band}:{low}:{high}".encode(), digest_size=8).digest()
        code = int.from_bytes(unit, "little", signed=True)
        at = np.zeros(len(names), np.int32)
        at[used] = np.arange(len(used), dtype=np.int32)
        pairs = np.stack([at[i], at[j]]).astype(np.int32).tobytes()
        n = len(used)
        return pa.table(
            {"unit": pa.array([code] * n, pa.int64()), "class": pa.array([names[u] for u in used], pa.binary()),
             "place": pa.array(np.arange(n), pa.int32()), "pairs": pa.array([pairs if k == 0 else None for k in range(n)], pa.binary())}
        )

    return group


def _pieces(members: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``members`` cut where their sizes add up to ``VERIFIED_SHINGLES``; a larger one stands alone or ends a piece."""
    at = np.cumsum(sizes[members]) // VERIFIED_SHINGLES
    return np.split(members, np.flatnonzero(np.diff(at)) + 1)


def _verify(threshold: float):
    """Of one unit: how many links each member has, and a smaller member it is joined with.

    The sets are read where Arrow holds them, and compared in pieces of bounded size.
    """

    def verify(table: pa.Table) -> pa.Table:
        order = np.argsort(table["place"].to_numpy(), kind="stable")
        names = table["class"].to_pylist()
        names = [names[k] for k in order]
        weights = table["copies"].to_numpy()[order]
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        sets = [held[k] for k in order]
        lengths = np.array([len(x) for x in sets])
        i, j = np.frombuffer(next(x for x in table["pairs"].to_pylist() if x is not None), np.int32).reshape(2, -1)
        texts, docs = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        root = list(range(len(names)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a in np.unique(i).tolist():
            mine, found = sets[a], []
            for others in _pieces(j[i == a], lengths):
                sizes = lengths[others]
                flat = np.concatenate([sets[b] for b in others.tolist()])
                spot = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                common = np.add.reduceat((mine[spot] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                union = sizes + len(mine) - common
                found.append(others[common >= threshold * union - 1e-9 * union])
            near = np.concatenate(found)
            texts[a] += len(near)
            docs[a] += weights[near].sum()
            texts[near] += 1
            docs[near] += weights[a]
            for b in near.tolist():
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        roots = [names[top(x)] for x in range(len(names))]
        return pa.table(
            {"class": pa.array(names, pa.binary()), "texts": texts, "docs": docs, "joined": pa.array(roots, pa.binary())}
        )

    return verify


def _components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class, root): the smallest class of each component of ``edges`` (class, joined).

    Each round hands the smallest neighbour of a class outward and then inward, until all
    components are stars. Rounds grow with the logarithm of a component's size.
    """
    rounds = Rounds()
    pairs = rounds.write(
        edges.filter("class <> joined")
        .select(F.greatest("class", "joined").alias("high"), F.least("class", "joined").alias("low")).distinct()
    )
    while True:
        both = pairs.select(F.col("high").alias("node"), F.col("low").alias("near")).unionByName(
            pairs.select(F.col("low").alias("node"), F.col("high").alias("near"))
        )
        larger = F.count(F.when(F.col("near") > F.col("node"), 1)).alias("larger")
        least = rounds.write(both.groupBy("node").agg(F.least("node", F.min("near")).alias("least"), larger).filter("larger > 0"))
        wide = rounds.write(
            hub_join(both.filter("near > node"), least, ["node"], "near", "larger")
            .select(F.col("near").alias("high"), F.col("least").alias("low")).distinct()
        )
        centre = rounds.write(wide.groupBy("high").agg(F.min("low").alias("centre"), F.count(F.lit(1)).alias("lows")))
        new = rounds.write(
            hub_join(wide, centre, ["high"], "low", "lows")
            .select(F.when(F.col("low") == F.col("centre"), F.col("high")).otherwise(F.col("low")).alias("high"), F.col("centre").alias("low"))
            .unionByName(centre.select("high", F.col("centre").alias("low"))).filter("high <> low").distinct()
        )
        done = new.count() == pairs.count() and new.exceptAll(pairs).isEmpty()
        rounds.keep(new)
        if done:
            return classes.join(new.withColumnsRenamed({"high": "class", "low": "root"}), "class", "left").withColumn(
                "root", F.coalesce("root", "class")
            )
        pairs = new


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text) with its class and its links.

    - class_id: the smallest doc_id among the texts with the same shingles, group_id: the
      smallest among all that links join (null where no doc_id of them is known)
    - copies: rows in the class; links: other classes with similarity ``threshold`` or
      more; linked_docs: the rows in these
    - is_first: whether the row is the one that stays of its group, the first by doc_id
      (null last) and hash of text; of rows that are alike, all have the same value

    Texts without a word (null and empty too) have no shingles: each is its own class,
    with no copies beside rows that are alike and no links. No rows give no rows.
    """
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.xxhash64("text").alias("hash")).alias("name"), "text")
    marked = saved(
        named.mapInArrow(_signatures, "name struct<unknown:boolean,doc_id:bigint,hash:bigint>, class binary, values binary"), "signatures", BATCH_ROWS
    )
    members = marked.select("name", F.coalesce("class", F.to_binary(F.md5(F.to_json("name")), F.lit("hex"))).alias("class"))
    classes = saved(
        marked.filter("class is not null").groupBy("class")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("name").alias("name"), F.first("values").alias("values")),
        "classes",
    )
    banded = saved(classes.select("class", "values").mapInArrow(_bands, "class binary, band long"), "bands")
    buckets = (
        banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        .withColumn("cuts", F.ceil(F.col("size") / BLOCK).cast("int"))
    )
    placed = banded.join(buckets, "band").withColumn("side", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int"))
    grid = placed.select("class", "band", "side", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    groups = grid.select("class", "band", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    units = saved(
        groups.join(classes.select("class", "values"), "class").groupBy("band", "low", "high")
        .applyInArrow(_candidates(threshold, tolerance), "unit long, class binary, place int, pairs binary"),
        "units", BATCH_ROWS,
    )
    needed = units.select("class").distinct().join(classes.select("class", "name", "copies"), "class")
    texts = named.join(needed, "name").select("class", "text")
    sets = saved(texts.mapInArrow(_shingles, "class binary, shingles binary"), "shingles", BATCH_ROWS)
    checked = saved(
        units.join(classes.select("class", "copies"), "class").join(sets.dropDuplicates(["class"]), "class").groupBy("unit")
        .applyInArrow(_verify(threshold), "class binary, texts long, docs long, joined binary"),
        "checked", BATCH_ROWS,
    )
    links = checked.groupBy("class").agg(F.sum("texts").alias("links"), F.sum("docs").alias("linked_docs"))
    roots = _components(links.select("class"), checked.select("class", "joined"))
    summary = (
        classes.select("class", "copies", F.col("name").alias("first"))
        .join(links, "class", "left").join(roots, "class", "left")
        .withColumn("root", F.coalesce("root", "class")).fillna(0, ["links", "linked_docs"])
    )
    lead = summary.groupBy("root").agg(F.min("first").alias("lead"))
    summary = summary.join(lead, "root")
    alone = members.join(summary.select("class", "copies", "first", "links", "linked_docs", "lead"), "class", "left")
    return alone.select(
        F.col("name.doc_id").alias("doc_id"),
        F.coalesce("first", "name").getField("doc_id").alias("class_id"),
        F.coalesce("lead", "name").getField("doc_id").alias("group_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"),
        (F.coalesce("lead", "name") == F.col("name")).alias("is_first"),
        F.col("name.hash").alias("text_hash"),
    )
