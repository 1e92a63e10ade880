"""Operators over node and edge tables.

Tables: ``nodes(graph_idx, entity, …)``, ``edges(graph_idx, parent, child)``.
All loops run on the whole tables, one round per hop, doubling or level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsets.functions.draws import chance, draw
from graphsets.operators.pairing import hub_join, pair_members
from graphsets.operators.ranking import group_indexed
from graphsets.session import Rounds, dealt, durable

WORD = 64  # worlds per packed bigint


def candidate_edges(nodes: DataFrame, same: list[str]) -> DataFrame:
    """Edges from earlier to later nodes (column ``ord``) of a graph that agree in the columns ``same``.

    Nodes with a null there agree with none.
    """
    earlier = nodes.select("graph_idx", *same, F.col("entity").alias("parent"), F.col("ord").alias("_a"))
    later = nodes.select("graph_idx", *same, F.col("entity").alias("child"), F.col("ord").alias("_b"))
    return (
        pair_members(earlier, later, ["graph_idx", *same], "parent")
        .filter(F.col("_a") < F.col("_b"))
        .select("graph_idx", "parent", "child")
    )


def root_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    children = edges.select("graph_idx", F.col("child").alias("entity"))
    return nodes.join(dealt(children), ["graph_idx", "entity"], "left_anti")


def assign_rules(nodes: DataFrame, edges: DataFrame, or_prob: float, seed: int) -> DataFrame:
    """Add ``rule``: ROOT without parents, else OR or AND by draw."""
    children = edges.select("graph_idx", F.col("child").alias("entity")).distinct()
    is_or = chance(or_prob, draw(seed, "rule", "graph_idx", "entity"))
    return nodes.join(
        dealt(children.withColumn("_inner", F.lit(True))), ["graph_idx", "entity"], "left"
    ).select(
        *nodes.columns,
        F.when(F.col("_inner").isNull(), "ROOT").when(is_or, "OR").otherwise("AND").alias("rule"),
    )


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sorted distinct ``parents`` and ``children`` of every node.

    One row carries one node's neighbours, as the answer texts need them.
    """
    up = edges.groupBy("graph_idx", F.col("child").alias("entity")).agg(
        F.array_sort(F.collect_set("parent")).alias("parents")
    )
    down = edges.groupBy("graph_idx", F.col("parent").alias("entity")).agg(
        F.array_sort(F.collect_set("child")).alias("children")
    )
    none = F.array().cast("array<string>")
    return (
        nodes.join(dealt(up), ["graph_idx", "entity"], "left")
        .join(dealt(down), ["graph_idx", "entity"], "left")
        .withColumn("parents", F.coalesce("parents", none))
        .withColumn("children", F.coalesce("children", none))
    )


def reachability(edges: DataFrame) -> DataFrame:
    """All pairs (graph_idx, ancestor, descendant) joined by a directed path.

    Path doubling: a round extends the newest pairs by all known pairs, so the
    number of rounds is the logarithm of the longest shortest path. The join needs no
    salt: its exchanges are Spark's own, so a node in the middle of very many paths
    is split by the adaptive skew join.
    """
    key = ["graph_idx", "ancestor", "descendant"]
    fresh = durable(
        edges.select(
            "graph_idx", F.col("parent").alias("ancestor"), F.col("child").alias("descendant")
        ).distinct()
    )
    known = fresh
    while True:
        onward = known.select(
            "graph_idx", F.col("ancestor").alias("descendant"), F.col("descendant").alias("_far")
        )
        longer = (
            fresh.join(onward, ["graph_idx", "descendant"])
            .select("graph_idx", "ancestor", F.col("_far").alias("descendant"))
            .filter(F.col("ancestor") != F.col("descendant"))
            .distinct()
        )
        fresh = durable(longer.join(known, key, "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def ordered_pairs(nodes: DataFrame, per_component: bool = False, numbered: bool = False) -> DataFrame:
    """Every ordered pair of different nodes of a graph (or component).

    The pairs are the result asked for, so their number cannot be avoided. If
    nodes hold ``split``, pairs hold first_split and second_split; if ``numbered``,
    second_ord.
    """
    on = ["graph_idx", "component_id"] if per_component else ["graph_idx"]

    def side(name):
        owner = [F.col("split").alias(f"{name}_split")] if "split" in nodes.columns else []
        return nodes.select(*on, F.col("entity").alias(name), *owner)

    first, second = side("first"), side("second")
    if numbered:
        number = nodes.select(*on, F.col("entity").alias("second"), F.col("ord").cast("bigint").alias("second_ord"))
        second = second.join(dealt(number), [*on, "second"])
    return pair_members(first, second, on, "first").filter(F.col("first") != F.col("second"))


def _star_round(pairs: DataFrame, rounds: Rounds) -> DataFrame:
    """Move every (high, low) pair closer to the smallest node of its component.

    First each node hands its smallest neighbour to its larger neighbours, then
    to its smaller ones. The pairs never get more than they were.
    """
    key = ["graph_idx", "node"]
    swapped = pairs.select("graph_idx", F.col("low").alias("high"), F.col("high").alias("low"))
    both = pairs.unionByName(swapped).withColumnsRenamed({"high": "node", "low": "near"})
    # A hub hands on its smallest neighbour in parts, as sub-centres that agree on it beforehand.
    larger = F.count(F.when(F.col("near") > F.col("node"), 1)).alias("_near")
    smallest = rounds.write(both.groupBy(*key).agg(F.least("node", F.min("near")).alias("low"), larger).filter("_near > 0"))
    outward = rounds.write(
        hub_join(both.filter(F.col("near") > F.col("node")), smallest, key, "near", "_near")
        .select("graph_idx", F.col("near").alias("high"), "low")
        .distinct()
    )
    centre = rounds.write(
        outward.groupBy("graph_idx", "high").agg(F.min("low").alias("_centre"), F.count(F.lit(1)).alias("_lows"))
    )
    inward = hub_join(outward, centre, ["graph_idx", "high"], "low", "_lows").select(
        "graph_idx",
        F.when(F.col("low") == F.col("_centre"), F.col("high")).otherwise(F.col("low")).alias("high"),
        F.col("_centre").alias("low"),
    )
    # A high node that loses its only smaller link keeps its centre.
    kept = centre.select("graph_idx", "high", F.col("_centre").alias("low"))
    return rounds.write(inward.unionByName(kept).distinct())


def _not_star(pairs: DataFrame) -> DataFrame:
    """Nodes with two lower ends, or that are a lower and an upper end."""
    ends = pairs.select("graph_idx", F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(
        pairs.select("graph_idx", F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return (
        ends.groupBy("graph_idx", "node")
        .agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        .filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))
    )


def component_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_idx, entity, component_root): the smallest node of each weak component.

    Alternates between handing smallest neighbours outward and inward until
    every component is a star around its smallest node. Rounds grow with the
    logarithm of a component's size, not with its diameter.
    """
    rounds = Rounds()
    pairs = rounds.write(
        edges.filter(F.col("parent") != F.col("child"))
        .select(
            "graph_idx",
            F.greatest("parent", "child").alias("high"),
            F.least("parent", "child").alias("low"),
        )
        .distinct()
    )
    while not _not_star(pairs).isEmpty():
        pairs = _star_round(pairs, rounds)
        rounds.keep(pairs)
    found = pairs.select("graph_idx", F.col("high").alias("entity"), F.col("low").alias("_root"))
    return nodes.select("graph_idx", "entity").join(dealt(found), ["graph_idx", "entity"], "left").select(
        "graph_idx", "entity", F.coalesce("_root", "entity").alias("component_root")
    )


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``component_root`` (smallest member) and ``component_id`` (dense per graph)."""
    members = durable(component_roots(nodes, edges))
    roots = members.filter(F.col("entity") == F.col("component_root")).select(
        "graph_idx", "component_root"
    )
    numbered = group_indexed(roots, ["graph_idx"], ["component_root"], "component_id")
    return nodes.join(dealt(members.join(dealt(numbered), ["graph_idx", "component_root"])), ["graph_idx", "entity"])


def _indegrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_idx", F.col("child").alias("entity")).agg(
        F.count(F.lit(1)).alias("missing")
    )


def _folded(edges: DataFrame, degrees: DataFrame, rounds: Rounds) -> DataFrame:
    """(graph_idx, entity, anchor, length) of the nodes with one parent.

    ``anchor`` is the nearest ancestor that has no parent or several, ``length`` the edges
    from there. Pointer jumping: a round doubles the steps of all pointers, so rounds
    follow the logarithm of the longest run of such nodes. Nodes behind a cycle of them
    have no anchor and no row.
    """
    key = ["graph_idx", "entity"]
    single = degrees.filter("missing = 1").select(*key)
    pointers = rounds.write(
        edges.withColumnRenamed("child", "entity").join(single, key)
        .select(*key, F.col("parent").alias("anchor"), F.lit(1).cast("bigint").alias("length"))
    )
    ends: list[DataFrame] = []
    for _ in range(pointers.count().bit_length() + 1):
        onward = reduce(DataFrame.unionByName, [*ends, pointers]).select(
            "graph_idx", F.col("entity").alias("anchor"), F.col("anchor").alias("_far"), F.col("length").alias("_more")
        )
        jumped = rounds.write(
            pointers.join(onward, ["graph_idx", "anchor"], "left").select(
                *key, F.coalesce("_far", "anchor").alias("anchor"),
                (F.col("length") + F.coalesce("_more", F.lit(0))).alias("length"), F.col("_far").isNotNull().alias("open"),
            ),
            "open",
        )
        ends.append(jumped.filter("not open").drop("open"))
        pointers = jumped.filter("open").drop("open")
        if pointers.isEmpty():
            break
    folded = rounds.write(reduce(DataFrame.unionByName, ends) if ends else pointers)
    rounds.keep(folded)
    return folded


def _contracted(edges: DataFrame, degrees: DataFrame, folded: DataFrame) -> DataFrame:
    """(graph_idx, anchor, entity, n, length): the edges into nodes with several parents, from anchor to node.

    ``n`` parents lie behind one anchor, the longest way among them is ``length``.
    """
    several = degrees.filter("missing > 1").select("graph_idx", F.col("entity").alias("child"))
    ends = folded.select("graph_idx", F.col("entity").alias("parent"), "anchor", "length")
    return (
        edges.join(several, ["graph_idx", "child"]).join(ends, ["graph_idx", "parent"], "left")
        .groupBy("graph_idx", F.coalesce("anchor", "parent").alias("anchor"), F.col("child").alias("entity"))
        .agg(F.count(F.lit(1)).alias("n"), (F.max(F.coalesce("length", F.lit(0))) + 1).alias("length"))
    )


def node_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``depth``, the longest path from a root (roots 0; null on a cycle and behind one).

    Runs of nodes with one parent are folded first, so the rounds follow the levels of
    nodes with several parents, and not the depth. Such a node settles in the round in which
    its last parent has; each folded edge is used once, when its anchor settles.
    """
    edges = durable(edges.select("graph_idx", "parent", "child").distinct())
    key = ["graph_idx", "entity"]
    roots = root_nodes(nodes.select(*key), edges)
    degrees = durable(_indegrees(edges))
    folded = _folded(edges, degrees, Rounds())
    joints = durable(_contracted(edges, degrees, folded))
    settled = durable(roots.withColumn("depth", F.lit(0).cast("bigint")))
    parts, waiting = [settled], None
    while not settled.isEmpty():
        came = (
            joints.join(settled.withColumnRenamed("entity", "anchor"), ["graph_idx", "anchor"])
            .groupBy(*key)
            .agg(F.sum("n").alias("seen"), F.max(F.col("depth") + F.col("length")).alias("depth"))
        )
        if waiting is not None:
            came = waiting.unionByName(came).groupBy(*key).agg(F.sum("seen").alias("seen"), F.max("depth").alias("depth"))
        # Only nodes that some parent has reached; the settled ones are files of their own.
        state = durable(came.join(degrees, key).withColumn("done", F.col("seen") == F.col("missing")), "done")
        settled = state.filter("done").select(*key, "depth")
        waiting = state.filter("not done").select(*key, "seen", "depth")
        parts.append(settled)
    joined = reduce(DataFrame.unionByName, parts)
    above = joined.select("graph_idx", F.col("entity").alias("anchor"), "depth")
    inside = folded.join(above, ["graph_idx", "anchor"]).select(*key, (F.col("depth") + F.col("length")).alias("depth"))
    return nodes.join(joined.unionByName(inside), key, "left")


def level_widths(levels: DataFrame) -> DataFrame:
    """Nodes per depth of each graph, and whether it is the graph's widest level."""
    widths = levels.groupBy("graph_idx", "depth").agg(F.count(F.lit(1)).alias("width"))
    widest = widths.groupBy("graph_idx").agg(F.max("width").alias("widest"))
    return widths.join(widest, "graph_idx")


def pack_worlds(facts: DataFrame) -> DataFrame:
    """Facts (graph_idx, entity, world_id, value) as 64 worlds per row.

    Column ``bits`` of (graph_idx, entity, word) holds world ``word * 64 + i`` in bit i.
    """
    bit = F.expr(f"shiftleft(1L, cast(world_id % {WORD} as int))")
    return facts.groupBy(
        "graph_idx", "entity", F.expr(f"cast(world_id div {WORD} as int)").alias("word")
    ).agg(F.bit_or(F.when(F.col("value"), bit).otherwise(F.lit(0))).cast("bigint").alias("bits"))


def unpack_worlds(words: DataFrame, num_worlds: int) -> DataFrame:
    """One row per world again."""
    return (
        words.select("*", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("_bit"))
        .withColumn("world_id", (F.col("word") * WORD + F.col("_bit")).cast("bigint"))
        .filter(F.col("world_id") < num_worlds)
        .withColumn("value", F.expr("getbit(bits, _bit) = 1"))
        .drop("_bit", "word", "bits")
    )


def propagate(nodes: DataFrame, edges: DataFrame, root_words: DataFrame) -> DataFrame:
    """Packed facts of all nodes, from the roots' packed facts and the rules.

    OR and AND over parents are ``bit_or`` and ``bit_and`` over words of 64
    worlds. A node with one parent has its value, so runs of these are folded and
    take the value of their anchor at the end. The others settle once all their parents
    have; every folded edge is used once.
    """
    key = ["graph_idx", "entity"]
    edges = durable(edges.select("graph_idx", "parent", "child").distinct())
    rule = F.when(F.col("rule").isin("OR", "AND"), F.col("rule")).otherwise(
        F.raise_error(F.concat(F.lit("unknown rule: "), F.col("rule"))).cast("string")
    )
    # Every inner node meets each word of its parents, so it needs no word list of its own.
    inner = durable(
        _indegrees(edges).join(nodes.select(*key, "rule"), key).withColumn("rule", rule)
    )
    folded = _folded(edges, inner.select(*key, "missing"), Rounds())
    joints = durable(_contracted(edges, inner.select(*key, "missing"), folded).drop("length"))
    settled = durable(root_words.select(*key, "word", "bits"))
    known = settled
    waiting = None
    while True:
        came = (
            joints.join(settled.withColumnRenamed("entity", "anchor"), ["graph_idx", "anchor"])
            .groupBy(*key, "word")
            .agg(
                F.sum("n").alias("seen"),
                F.bit_or("bits").alias("any_bits"),
                F.bit_and("bits").alias("all_bits"),
            )
        )
        if waiting is not None:
            came = (
                waiting.unionByName(came)
                .groupBy(*key, "word")
                .agg(
                    F.sum("seen").alias("seen"),
                    F.bit_or("any_bits").alias("any_bits"),
                    F.bit_and("all_bits").alias("all_bits"),
                )
            )
        # The settled rows are files of their own, so no later round reads the others.
        state = durable(came.join(inner, key).withColumn("done", F.col("seen") == F.col("missing")), "done")
        bits = F.when(F.col("rule") == "OR", F.col("any_bits")).otherwise(F.col("all_bits"))
        settled = state.filter("done").select(*key, "word", bits.alias("bits"))
        if settled.isEmpty():
            break
        known = known.unionByName(settled)
        waiting = state.filter("not done").select(*key, "word", "seen", "any_bits", "all_bits")
    values = known.select("graph_idx", F.col("entity").alias("anchor"), "word", "bits")
    return known.unionByName(folded.join(values, ["graph_idx", "anchor"]).select(*key, "word", "bits"))


def unresolved_nodes(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes with a parent that is not among ``known(graph_idx, entity)``."""
    open_edges = edges.join(
        known.select("graph_idx", F.col("entity").alias("parent")).distinct(),
        ["graph_idx", "parent"],
        "left_anti",
    )
    children = open_edges.select("graph_idx", F.col("child").alias("entity"))
    return nodes.join(children, ["graph_idx", "entity"], "left_semi")
