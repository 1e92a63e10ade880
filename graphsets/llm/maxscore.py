"""Exact top-k by inner product with the MaxScore rule.

A vector's components are weights of terms. For a query, each term adds at most its
weight times the spread of the term's list; terms are taken by falling bound. Those
terms whose bounds together cannot lift a vector above the k-th score so far are not
essential: vectors are found through the lists of the essential terms, and only those
that can still compete are probed for the others. Vectors lie in shards and queries in
blocks; each pair of them is one group of bounded size, and the best of all shards merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphsets.llm.store import saved, shuffle_parts

SHARD_ROWS = 4096
BLOCK_QUERIES = 2048
SEEDS = 64
EACH = 4  # lists between two looks at the k-th partial score


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, vector): floor(scale * x) of each component, as doubles.

    Rows with a null vec_id, a null vector, or a null or non-finite component take no
    part. ``row`` names a row, so rows that repeat a vec_id all stay. Shorter
    vectors score as if filled with zeros. Scores must fit in 64 bits.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")
    )
    return saved(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    lengths = np.diff(ends)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Shard:
    """Impact lists of a shard: for each term how far a vector is above the list's least, and below its most."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.least, self.most = vectors.min(axis=0), vectors.max(axis=0)
        self.rising = np.ascontiguousarray((self.vectors - self.least).T)
        self.falling = np.ascontiguousarray((self.most - self.vectors).T)
        self.spread = self.most - self.least

    def search(self, own: int, query: np.ndarray, k: int, level: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, vectors probed to the end) of the k best but row ``own``, ties to the smaller id; all if there are fewer.

        ``level`` is a score that k vectors elsewhere have reached.
        """
        weight = np.abs(query)
        base = int(np.where(query >= 0, query * self.least, query * self.most).sum())
        bound = weight * self.spread
        terms = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # most that terms from here on can add
        others = self.rows != own
        lists = [(self.rising if query[t] >= 0 else self.falling)[t] for t in terms.tolist()]

        def raised(reached: np.ndarray) -> int | None:
            """The level, or the k-th of scores that vectors have at least."""
            if len(reached) < k:
                return level
            kth = int(np.partition(reached, len(reached) - k)[len(reached) - k])
            return kth if level is None else max(level, kth)

        seeds = np.argsort(-lists[0], kind="stable")[: SEEDS + 1] if lists else np.arange(len(self.ids))[: SEEDS + 1]
        level = raised(self.vectors[seeds[others[seeds]]] @ query)
        score = np.full(len(self.ids), base, np.int64)
        met = np.zeros(len(self.ids), bool)
        at = 0
        while at < len(terms) and (level is None or base + rest[at] >= level):
            score += weight[terms[at]] * lists[at]
            met |= lists[at] > 0
            at += 1
            if at % EACH == 0:
                level = raised(score[others])
        if at == len(terms) and (level is None or base >= level):
            met[:] = True
        alive = np.flatnonzero(met & others)
        score = score[alive]
        while True:
            if level is not None:
                keep = score + rest[at] >= level
                if not keep.all():
                    alive, score = alive[keep], score[keep]
            if at == len(terms):
                break
            score = score + weight[terms[at]] * lists[at][alive]
            at += 1
            if at % EACH == 0:
                level = raised(score)
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best], len(alive)


def _search_group(k: int):
    def search(table: pa.Table) -> pa.Table:
        asked = table["is_query"].to_numpy().astype(bool)
        width = max(1, int(pa.compute.max(pa.compute.list_value_length(table["vector"])).as_py() or 0))
        vectors, ids, rows = _matrix(table["vector"], width), table["vec_id"].to_numpy(), table["row"].to_numpy()
        levels = table["level"].to_pylist()
        out: tuple[list, ...] = ([], [], [], [])
        if (~asked).any():
            shard = Shard(rows[~asked], ids[~asked], vectors[~asked])
            for at in np.flatnonzero(asked).tolist():
                found, score, _ = shard.search(int(rows[at]), vectors[at], k, levels[at])
                for column, value in zip(out, (np.full(len(found), rows[at]), np.full(len(found), ids[at]), found, score), strict=True):
                    column.append(value)
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), columns, strict=True)))

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query.

    Both sides have (row, vec_id, vector); a query's own row is no candidate, rows of the same
    vec_id are. Rows that repeat a query's vec_id are queries of their own. Ties go to
    the smaller vec_id. Fewer candidates give fewer rows, an empty side gives none.
    """
    vectors, queries = vectors.select("row", "vec_id", "vector"), saved(queries.select("row", "vec_id", "vector"), "queries")
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long")

    def searched(where, places: DataFrame) -> DataFrame:
        """The best of the shards that meet ``where``; ``places`` are queries with a level and a shard."""
        dealt = vectors.select(
            F.lit(0).alias("is_query"), "row", "vec_id", "vector", F.lit(None).cast("long").alias("level"), shard.alias("shard"),
            F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"),
        ).filter(where)
        asked = places.select(
            F.lit(1).alias("is_query"), "row", "vec_id", "vector", "level", "shard",
            F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("long").alias("block"),
        )
        parts = max(shuffle_parts(vectors), min(shards * blocks, 100_000))
        return dealt.unionByName(asked).repartition(parts, "shard", "block").groupBy("shard", "block").applyInArrow(
            _search_group(k), "row long, query_id long, vec_id long, score long"
        )

    first = saved(searched(F.col("shard") == 0, queries.withColumns({"level": F.lit(None).cast("long"), "shard": F.lit(0).cast("long")})), "first_shard")
    found = first
    if shards > 1:
        reached = first.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("level"))
        others = queries.join(reached, "row", "left").withColumn("shard", F.explode(F.expr(f"sequence(1L, {shards - 1}L)")))
        found = first.unionByName(searched(F.col("shard") > 0, others))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")  # k rows of each shard
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
