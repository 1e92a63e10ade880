import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphsets.operators import closure, graph, pairing
from graphsets import session
from graphsets.session import durable
from tests import model


def random_graphs(seed, graphs=6, size=12, p=0.2):
    rng = random.Random(seed)
    nodes, edges = {}, {}
    for g in range(graphs):
        names = [f"N{g}{i:02d}" for i in rng.sample(range(99), size)]
        nodes[g] = names
        edges[g] = [
            (names[i], names[j]) for i in range(size) for j in range(i + 1, size) if rng.random() < p
        ]
    return nodes, edges


def frames(spark, nodes, edges):
    n = [(g, e, i) for g, names in nodes.items() for i, e in enumerate(names)]
    e = [(g, a, b) for g, pairs in edges.items() for a, b in pairs]
    return (
        spark.createDataFrame(n, "graph_idx bigint, entity string, ord bigint"),
        spark.createDataFrame(e, "graph_idx bigint, parent string, child string"),
    )


@pytest.fixture(scope="module")
def world(spark):
    nodes, edges = random_graphs(1)
    # one hot graph, isolated nodes and a long chain
    nodes[6] = [f"H{i:02d}" for i in range(40)]
    edges[6] = [("H00", f"H{i:02d}") for i in range(1, 30)]
    nodes[7] = [f"C{i:02d}" for i in range(33)]
    edges[7] = [(f"C{i:02d}", f"C{i + 1:02d}") for i in range(32)]
    n, e = frames(spark, nodes, edges)
    return nodes, edges, n.cache(), e.cache()


def test_closure(world):
    _, edges, _, e = world
    got = {(r.graph_idx, r.ancestor, r.descendant) for r in graph.reachability(e).collect()}
    assert got == {(g, a, b) for g in edges for a, b in model.closure(edges[g])}


def test_closure_of_a_cycle_leaves_self_out(spark):
    e = spark.createDataFrame(
        [(0, "a", "b"), (0, "b", "c"), (0, "c", "a")], "graph_idx bigint, parent string, child string"
    )
    got = {(r.ancestor, r.descendant) for r in graph.reachability(e).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc" if x != y}


def test_relations(world):
    nodes, edges, n, e = world
    words = closure.related_words(n, e)
    rows = closure.pair_relations(graph.ordered_pairs(n, numbered=True), words).collect()
    assert len(rows) == sum(len(v) * (len(v) - 1) for v in nodes.values())
    reach = {g: model.closure(edges[g]) for g in edges}
    for r in rows:
        pairs = reach[r.graph_idx]
        want = (
            "ancestor" if (r.first, r.second) in pairs
            else "descendant" if (r.second, r.first) in pairs else "independent"
        )
        assert r.relation == want


@pytest.mark.parametrize("step,first", [(1, 0), (37, 5)])
def test_bitmaps_hold_the_closure(world, step, first):
    """Also where numbers are not dense, so that a graph of 40 nodes spans many blocks."""
    nodes, edges, n, e = world
    words = closure.related_words(n.withColumn("ord", F.col("ord") * step + first), e).collect()
    name = {(g, i * step + first): x for g in nodes for i, x in enumerate(nodes[g])}
    got = {"down": set(), "up": set()}
    for r in words:
        for side, pairs in got.items():
            bits = r[side] & ((1 << 64) - 1)
            pairs |= {(r.graph_idx, r.entity, name[r.graph_idx, r.block * 64 + i]) for i in range(64) if bits >> i & 1}
    want = {(g, a, b) for g in edges for a, b in model.closure(edges[g])}
    assert got["down"] == want and got["up"] == {(g, b, a) for g, a, b in want}
    assert len(words) == len({(r.graph_idx, r.entity, r.block) for r in words})
    counts = closure.relative_counts(n, closure.related_words(n, e), "down", "descendants").collect()
    assert {(r.graph_idx, r.entity): r.descendants for r in counts} == {
        (g, x): sum((h, a) == (g, x) for h, a, _ in want) for g in nodes for x in nodes[g]
    }


def test_bitmaps_of_a_cycle_leave_self_out(spark):
    n, e = frames(spark, {0: ["a", "b", "c"], 1: ["x"]}, {0: [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")], 1: []})
    got = {(r.entity, r.block, r.down, r.up) for r in closure.related_words(n, e).collect()}
    assert got == {("a", 0, 6, 6), ("b", 0, 5, 5), ("c", 0, 3, 3)}


def test_components(world):
    nodes, edges, n, e = world
    got = {r.entity: (r.component_root, r.component_id) for r in graph.weak_components(n, e).collect()}
    want = {}
    for g in nodes:
        want.update(model.components(nodes[g], edges[g]))
    assert got == want


def test_components_without_edges(spark):
    n, e = frames(spark, {0: ["b", "a"]}, {0: []})
    got = {r.entity: r.component_id for r in graph.weak_components(n, e).collect()}
    assert got == {"a": 0, "b": 1}


def test_levels(world):
    nodes, edges, n, e = world
    got = {r.entity: r.depth for r in graph.node_levels(n, e).collect()}
    for g in nodes:
        depth = {x: 0 for x in nodes[g]}
        for _ in nodes[g]:
            for a, b in edges[g]:
                depth[b] = max(depth[b], depth[a] + 1)
        assert {x: got[x] for x in nodes[g]} == depth
    widths = graph.level_widths(graph.node_levels(n, e)).filter("graph_idx = 6").collect()
    assert {(r.depth, r.width, r.widest) for r in widths} == {(0, 11, 29), (1, 29, 29)}


def test_levels_are_null_on_a_cycle(spark):
    n, e = frames(spark, {0: ["r", "a", "b"]}, {0: [("r", "a"), ("a", "b"), ("b", "a")]})
    assert {r.entity: r.depth for r in graph.node_levels(n, e).collect()} == {"r": 0, "a": None, "b": None}


def some_facts(roots, worlds):
    """Every root in every world, true for about half of them."""
    rows = roots.select("graph_idx", "entity", F.explode(F.expr(f"sequence(0L, {worlds - 1}L)")).alias("world_id"))
    return rows.withColumn("value", F.pmod(F.xxhash64("graph_idx", "entity", "world_id"), F.lit(2)) == 0)


def test_propagation_over_more_than_one_word(world):
    nodes, edges, n, e = world
    worlds = 70
    ruled = graph.assign_rules(n, e, 0.5, 7).cache()
    rules = {r.entity: r.rule for r in ruled.collect()}
    facts = some_facts(graph.root_nodes(n, e), worlds).cache()
    given = {}
    for r in facts.collect():
        given.setdefault((r.graph_idx, r.world_id), {})[r.entity] = r.value
    words = graph.propagate(ruled, e, graph.pack_worlds(facts))
    got = {(r.graph_idx, r.world_id, r.entity): r.value for r in graph.unpack_worlds(words, worlds).collect()}
    want = {
        (g, w, x): v
        for (g, w), roots in given.items()
        for x, v in model.world(nodes[g], edges[g], rules, roots).items()
    }
    assert got == want


def test_unknown_rule_is_an_error(spark):
    n, e = frames(spark, {0: ["a", "b"]}, {0: [("a", "b")]})
    words = graph.pack_worlds(some_facts(graph.root_nodes(n, e), 2))
    with pytest.raises(PySparkException, match="unknown rule: XOR"):
        graph.propagate(n.withColumn("rule", F.lit("XOR")), e, words).collect()


def test_unresolved(spark):
    n, e = frames(spark, {0: ["a", "b", "c"]}, {0: [("a", "b"), ("b", "c")]})
    got = graph.unresolved_nodes(n, e, graph.root_nodes(n, e)).collect()
    assert [r.entity for r in got] == ["c"]


def test_candidate_edges(spark):
    rows = [(0, "a", 0, "x"), (0, "b", 1, "y"), (0, "c", 2, "x"), (0, "d", 3, "x"), (0, "e", 4, None), (0, "f", 5, None), (1, "g", 9, "x")]
    n = spark.createDataFrame(rows, "graph_idx bigint, entity string, ord bigint, kind string")
    got = sorted((r.parent, r.child) for r in graph.candidate_edges(n, ["kind"]).collect())
    assert got == [("a", "c"), ("a", "d"), ("c", "d")]


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """A thousand nodes in a row, then a node with two parents, and one with a long and a short way."""
    names = [f"K{i:04d}" for i in range(1000)]
    links = list(zip(names, names[1:])) + [("K0999", "m"), ("r2", "m"), ("m", "z"), ("K0001", "z"), ("z", "zz"), ("zz", "zzz")]
    n, e = frames(spark, {0: [*names, "r2", "m", "z", "zz", "zzz"]}, {0: links})
    made = []
    written = session._written
    monkeypatch.setattr(session, "_written", lambda *a: made.append(a) or written(*a))
    depth = {r.entity: r.depth for r in graph.node_levels(n, e).collect()}
    assert len(made) <= 22  # ten doublings, three levels of nodes with two parents, and the given tables
    assert depth == {x: i for i, x in enumerate(names)} | {"r2": 0, "m": 1000, "z": 1001, "zz": 1002, "zzz": 1003}
    made.clear()
    ruled = n.withColumn("rule", F.when(F.col("entity") == "m", "AND").otherwise("OR"))
    words = spark.createDataFrame([(0, "K0000", 0, 6), (0, "r2", 0, 3)], "graph_idx bigint, entity string, word int, bits bigint")
    got = {r.entity: r.bits for r in graph.propagate(ruled, e, words).collect()}
    assert len(made) <= 21
    assert got == {x: 6 for x in names} | {"r2": 3, "m": 2, "z": 6, "zz": 6, "zzz": 6}


def test_nodes_behind_a_cycle_have_no_depth(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("r", "e"), ("r", "s"), ("s", "s2"), ("q", "q")]
    n, e = frames(spark, {0: ["a", "b", "c", "d", "e", "r", "s", "s2", "q"]}, {0: edges})
    got = {r.entity: r.depth for r in graph.node_levels(n, e).collect()}
    assert got == {"r": 0, "s": 1, "s2": 2} | {x: None for x in "abcdeq"}


def test_a_hub_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(pairing, "HUB_ROWS", 200)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
        keyed = durable(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")))
        joined = pairing.hub_join(rows, keyed, ["k"], "v", "n")
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert joined.columns == ["k", "v", "top"] and sum(sizes) == 20_000
        assert sizes[-1] < 2 * sizes[len(sizes) // 2]
        assert joined.filter("k = 0").agg(F.min("top"), F.max("top"), F.count("*")).first()[:] == (19_998, 19_998, 10_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_around_hubs(spark, monkeypatch):
    monkeypatch.setattr(pairing, "HUB_ROWS", 8)
    edges = [("h0", f"x{i:03d}") for i in range(150)] + [(f"x{i:03d}", f"y{i:03d}") for i in range(0, 150, 3)]
    edges += [(f"a{i:02d}", "low") for i in range(60)] + [("y000", "zz"), ("zz", "h9")] + [("h9", f"w{i:02d}") for i in range(40)]
    names = sorted({x for pair in edges for x in pair})
    n, e = frames(spark, {0: [*names, "alone"]}, {0: edges})
    got = {r.entity: (r.component_root, r.component_id) for r in graph.weak_components(n, e).collect()}
    assert got == model.components([*names, "alone"], edges)


def test_loops_leave_only_their_result(spark, world):
    """Tables that the next round replaces are deleted once it is committed."""
    _, _, n, e = world

    def left():
        folder = session.run_folder(spark).removeprefix("file:")
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    for make, most in (
        (lambda: graph.component_roots(n, e), 1),
        (lambda: closure.related_words(n, e), 1),
        (lambda: graph.node_levels(n, e), 16),  # the given tables, and a state for each level that holds settled nodes
    ):
        before = left()
        made = make()
        rows = made.count()
        assert len(left() - before) <= most and made.count() == rows > 0


def test_the_end_of_a_run_deletes_its_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "workspace", lambda _: str(tmp_path))
    assert durable(spark.range(3)).count() == 3 and len(os.listdir(session.run_folder(spark))) == 1
    session.end_run(spark)
    assert not os.path.exists(session.run_folder(spark))
