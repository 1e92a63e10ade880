"""Reachability as bitmaps: 64 nodes of a graph in one bigint.

Row (graph_idx, entity, block) holds the nodes with ``ord`` from 64 * block on: bit
``ord % 64`` of ``down`` says that the node is a descendant of entity, of ``up`` that it is
an ancestor. A relation is one bit, and counts are bit counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsets.operators.pairing import near_join
from graphsets.session import Rounds, dealt, small_side

BLOCK = 64


def _bit(number: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({number} % {BLOCK} as int))")


def _packed(pairs: DataFrame, owner: str, member: str) -> DataFrame:
    """(graph_idx, owner, block, bits) of numbered pairs."""
    return pairs.groupBy("graph_idx", owner, F.expr(f"{member} div {BLOCK}").alias("block")).agg(
        F.bit_or(_bit(member)).alias("bits")
    )


def _members(words: DataFrame, owner: str, member: str) -> DataFrame:
    """The pairs of packed rows."""
    spread = words.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).filter("getbit(bits, _b) = 1")
    return spread.select("graph_idx", owner, (F.col("block") * BLOCK + F.col("_b")).alias(member))


def _below(edges: DataFrame) -> DataFrame:
    """(graph_idx, a, block, bits): all descendants of each node a, from numbered edges (a, b).

    Path doubling: a round extends the newest descendants by all that is known, 64 of them
    a row, so a dense closure moves 64 times fewer rows than its pairs.
    """
    key = ["graph_idx", "a", "block"]
    rounds = Rounds()
    known = fresh = rounds.write(_packed(edges.filter("a <> b"), "a", "b"))
    itself = F.when(F.col("block") == F.expr(f"a div {BLOCK}"), F.bitwise_not(_bit("a"))).otherwise(F.lit(-1).cast("bigint"))
    while True:
        onward = known.withColumnRenamed("a", "mid")
        reached = _members(fresh, "a", "mid").join(dealt(onward), ["graph_idx", "mid"]).groupBy(*key).agg(F.bit_or("bits").alias("_new"))
        added = reached.join(dealt(known), key, "left").select(
            *key, F.col("_new").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("bigint")))).bitwiseAND(itself).alias("bits")
        )
        fresh = rounds.write(added.filter("bits <> 0"))
        if fresh.isEmpty():
            rounds.keep(known)
            return known
        known = rounds.write(known.unionByName(fresh).groupBy(*key).agg(F.bit_or("bits").alias("bits")))
        rounds.keep(known, fresh)


def related_words(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_idx, entity, block, down, up) of nodes(graph_idx, entity, ord); nodes without relatives have no row.

    ``ord`` numbers the nodes of a graph; it need not be dense. On a cycle a node is not its
    own relative.
    """
    number = nodes.select("graph_idx", "entity", F.col("ord").cast("bigint").alias("ord"))
    parent = number.withColumnsRenamed({"entity": "parent", "ord": "a"})
    child = number.withColumnsRenamed({"entity": "child", "ord": "b"})
    numbered = edges.join(dealt(parent), ["graph_idx", "parent"]).join(dealt(child), ["graph_idx", "child"]).select("graph_idx", "a", "b")
    down = _below(numbered)
    up = _packed(_members(down, "a", "b"), "b", "a")
    none = F.lit(0).cast("bigint")
    both = down.select("graph_idx", F.col("a").alias("ord"), "block", F.col("bits").alias("down"), none.alias("up")).unionByName(
        up.select("graph_idx", F.col("b").alias("ord"), "block", none.alias("down"), F.col("bits").alias("up"))
    )
    merged = both.groupBy("graph_idx", "ord", "block").agg(F.bit_or("down").alias("down"), F.bit_or("up").alias("up"))
    return merged.join(dealt(number), ["graph_idx", "ord"]).select("graph_idx", "entity", "block", "down", "up")


def with_relation(
    rows: DataFrame, words: DataFrame, seen: Column, other: str, out: str, near: bool = False
) -> DataFrame:
    """Add what ``seen`` is to the node numbered ``other``: ancestor, descendant or independent; null if seen is null.

    ``near`` says that all graphs are small (see ``near_join``).
    """
    bits = words.select("graph_idx", F.col("entity").alias("_seen"), F.col("block").alias("_block"), "down", "up")

    def has(name: str) -> Column:
        return F.expr(f"getbit({name}, cast({other} % {BLOCK} as int)) = 1")

    relation = F.when(F.col("_seen").isNull(), F.lit(None)).when(has("down"), "ancestor").when(has("up"), "descendant")
    placed = rows.withColumn("_seen", seen).withColumn("_block", F.expr(f"{other} div {BLOCK}"))
    key = ["graph_idx", "_seen", "_block"]
    return (
        (near_join(placed, bits, key[0], key[1:], "left") if near else placed.join(bits, key, "left"))
        .withColumn(out, relation.otherwise("independent"))
        .drop("_seen", "_block", "down", "up")
    )


def pair_relations(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``relation``, what ``first`` is to ``second``, to pairs (graph_idx, first, second, second_ord)."""
    return with_relation(pairs, small_side(words), F.col("first"), "second_ord", "relation").drop("second_ord")


def relative_counts(nodes: DataFrame, words: DataFrame, side: str, out: str) -> DataFrame:
    """(graph_idx, entity, out): how many ancestors (side ``up``) or descendants (``down``) each node has."""
    counts = words.groupBy("graph_idx", "entity").agg(F.sum(F.bit_count(side)).alias("_n"))
    return nodes.join(dealt(counts), ["graph_idx", "entity"], "left").select(
        "graph_idx", "entity", F.coalesce("_n", F.lit(0)).cast("bigint").alias(out)
    )
