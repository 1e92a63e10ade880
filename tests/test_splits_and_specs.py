from collections import Counter
from itertools import combinations
from math import comb

import pytest
from pyspark.sql import functions as F

from graphsets.functions import combinations as combos
from graphsets.operators import closure, graph, specs, splits
from graphsets.plans.dataset import DatasetBuilder, DatasetConfig, GraphTables
from graphsets.session import durable
from tests import model

RATIOS = [(0.0, 0.0), (0.1, 0.1), (0.5, 0.5), (0.15, 0.25), (0.5, 0.1), (0.1, 0.9), (0.9, 0.9), (1.0, 1.0), (0.0, 1.0)]


@pytest.mark.parametrize("val,test", RATIOS)
def test_split_sizes(spark, val, test):
    counts = spark.range(0, 60).withColumnRenamed("id", "n")
    v, t = splits.split_sizes(F.col("n"), val, test)
    got = {r.n: (r.v, r.t) for r in counts.select("n", v.alias("v"), t.alias("t")).collect()}
    assert got == {n: model.split_sizes(n, val, test) for n in range(60)}


def test_split_is_exact_with_a_hot_group(spark):
    items = spark.range(0, 3000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50 + 1).cast("bigint").alias("graph_idx"),
        F.col("id").cast("string").alias("entity"),
    )
    rows = splits.split_by_node(items, 0.1, 0.2, 5).collect()
    assert len(rows) == 3000
    per = Counter((r.graph_idx, r.split) for r in rows)
    for g, n in Counter(r.graph_idx for r in rows).items():
        assert (per[g, "val"], per[g, "test"]) == model.split_sizes(n, 0.1, 0.2)
    again = splits.split_by_node(items.repartition(7), 0.1, 0.2, 5).collect()
    assert sorted(rows) == sorted(again)


def test_null_groups_are_split_too(spark):
    items = spark.createDataFrame([(None if i % 2 else 1, str(i)) for i in range(20)], "graph_idx bigint, entity string")
    per = Counter((r.graph_idx, r.split) for r in splits.split_by_node(items, 0.2, 0.2, 5).collect())
    assert per == {(g, s): n for g in (None, 1) for s, n in (("train", 6), ("val", 2), ("test", 2))}


def test_whole_graphs_are_split(spark):
    items = spark.range(0, 400).select((F.col("id") % 20).alias("graph_idx"), F.col("id").cast("string").alias("entity"))
    rows = splits.split_by_graph(items, 0.1, 0.1, 5).collect()
    homes = {(r.graph_idx, r.split) for r in rows}
    assert len(homes) == 20
    assert Counter(s for _, s in homes) == {"train": 16, "val": 2, "test": 2}


def test_strictest_split(spark):
    rows = spark.createDataFrame(
        [("train", "test", "test"), ("val", "train", "val"), ("test", "val", "test"), (None, "val", "val"),
         (None, None, "train"), ("train", "train", "train")], "a string, b string, want string")
    got = rows.withColumn("got", splits.strictest_split(F.col("a"), F.col("b"))).collect()
    assert all(r.got == r.want for r in got)


def test_bad_scope(spark):
    with pytest.raises(ValueError):
        splits.entity_splits(spark.createDataFrame([(0, "a")], "graph_idx bigint, entity string"), "worlds", 0.1, 0.1, 1)


NODES = [(0, f"A{i}", i, i % 2) for i in range(7)] + [(1, f"B{i}", i, 0) for i in range(4)] + [(2, "C0", 0, 0)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "graph_idx bigint, entity string, ord bigint, component_id bigint").cache()


@pytest.mark.parametrize("size,per_component", [(1, False), (2, False), (3, False), (2, True)])
def test_specs(nodes, size, per_component):
    rows = specs.observation_specs(nodes, size, per_component).collect()
    for g in (0, 1, 2):
        home = {e: c if per_component else 0 for gg, e, _, c in NODES if gg == g}
        mine = sorted((r for r in rows if r.graph_idx == g), key=lambda r: r.spec_ord)
        assert [r.spec_ord for r in mine] == list(range(len(mine)))
        seen = [(r.query_entity, tuple(r.observed_entities)) for r in mine]
        assert len(set(seen)) == len(seen)
        per_query = Counter((q, len(o)) for q, o in seen)
        for query, c in home.items():
            others = sum(1 for e, d in home.items() if e != query and d == c)
            assert [per_query[query, k] for k in range(1, size + 1)] == [comb(others, k) for k in range(1, size + 1)]
        assert all(q not in o and list(o) == sorted(set(o)) and all(home[e] == home[q] for e in o) for q, o in seen)
        assert seen == sorted(seen, key=lambda s: (s[0], len(s[1]), s[1]))


@pytest.mark.parametrize("size,per_component", [(1, False), (2, False), (3, True), (4, False)])
def test_numbers_stand_for_their_specs(spark, size, per_component):
    """Also with one component beside many small ones, whose queries lie between its own, and gaps in ``ord``."""
    rows = [(0, f"A{i:03d}", i * 3 + 1, 0 if i % 4 == 0 else i // 2) for i in range(40)] + NODES[7:]
    nodes = spark.createDataFrame(rows, "graph_idx bigint, entity string, ord bigint, component_id bigint").filter("ord < 24 OR component_id = 0")
    every = durable(specs.observation_specs(nodes, size, per_component))
    placed = specs.placed_nodes(nodes, per_component)
    queries = specs.spec_queries(placed, size, per_component)
    numbers = every.select("graph_idx", "spec_ord", (F.col("spec_ord") * 7).alias("world_id"))
    found = specs.unrank_specs(numbers, placed, queries, size, per_component)
    assert found.filter("world_id <> spec_ord * 7").isEmpty()
    columns = [*every.columns]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, every.select(columns).collect()))


@pytest.mark.parametrize("size,count", [(1, 9), (2, 9), (3, 8), (5, 9)])
def test_sets_and_numbers(spark, size, count):
    sets = list(combinations(range(count), size))
    df = spark.createDataFrame([(i, count, size, list(c)) for i, c in enumerate(sets)], "i bigint, n bigint, k int, c array<bigint>")
    back = combos.unrank_sets(df, F.col("i"), "n", "k", size, "got").withColumn(
        "number", combos.set_rank([F.col("c")[j] for j in range(size)], F.col("n"))
    )
    assert all(r.got == r.c and r.number == r.i for r in back.collect())


@pytest.mark.parametrize("size", [2, 3, 4])
def test_largest_is_exact_for_large_numbers(spark, size):
    tops = [size, 10, 1000, 54_321, 2_000_000 if size < 4 else 100_000]
    totals = [comb(d, size) + off for d in tops for off in (-1, 0, 1) if comb(d, size) + off >= 0]
    df = spark.createDataFrame([(t,) for t in totals], "t bigint")
    for row in df.withColumn("d", combos.largest(F.col("t"), size)).collect():
        assert comb(row.d, size) <= row.t < comb(row.d + 1, size)


def test_samples_read_no_specs(spark, nodes, monkeypatch):
    """Observations are built from drawn numbers; the table of all specs is not made."""
    edges = spark.createDataFrame([(0, "A0", "A1"), (1, "B1", "B2")], "graph_idx bigint, parent string, child string")
    facts = nodes.select("graph_idx", "entity", F.lit(0).alias("word"), F.lit(5).cast("bigint").alias("bits"))
    ruled = nodes.join(edges.select("graph_idx", F.col("child").alias("entity")), ["graph_idx", "entity"], "left_anti")
    words = facts.join(ruled.select("graph_idx", "entity"), ["graph_idx", "entity"])
    given = GraphTables(graph.assign_rules(nodes, edges, 1.0, 1), edges, words, nodes, ("ord",))
    builder = DatasetBuilder(given, DatasetConfig(num_worlds=3, sample_ratio_from_worlds=0.5))
    monkeypatch.setattr(specs, "observation_specs", None)
    rows = builder.observed().collect()
    assert Counter((r.graph_idx, r.world_id) for r in rows) == {(0, w): 74 for w in range(3)} | {(1, w): 12 for w in range(3)}
    assert all(len(r.observed_values) == r.obs_size == len(r.observed_entities) for r in rows)


@pytest.mark.parametrize("ratio", [0.0, 0.001, 0.1, 0.4, 0.55, 0.9, 1.0])
def test_sample_sizes(nodes, ratio):
    counted = specs.spec_counts(specs.spec_queries(specs.placed_nodes(nodes), 2))
    counts = Counter(r.graph_idx for r in specs.observation_specs(nodes, 2).collect())
    assert {r.graph_idx: r.n for r in counted.collect()} == counts
    rows = specs.sample_per_world(counted, 9, ratio, 3).collect()
    assert len(set(rows)) == len(rows)
    got = Counter((r.graph_idx, r.world_id) for r in rows)
    want = {}
    for g, n in counts.items():
        keep = n if ratio >= 1 else 0 if ratio <= 0 else min(n, max(1, round(n * ratio)))
        want.update({(g, w): keep for w in range(9) if keep})
    assert got == want
    assert all(0 <= r.spec_ord < counts[r.graph_idx] for r in rows)


def test_sample_is_even_and_fresh_per_world(nodes):
    counted = specs.spec_counts(specs.spec_queries(specs.placed_nodes(nodes.filter("graph_idx = 1")), 2)).cache()
    n = counted.first()["n"]
    rows = specs.sample_per_world(counted, 600, 0.25, 11).collect()
    per_spec = Counter(r.spec_ord for r in rows)
    mean = len(rows) / n
    assert len(per_spec) == n and all(0.7 * mean < c < 1.3 * mean for c in per_spec.values())
    worlds = {}
    for r in rows:
        worlds.setdefault(r.world_id, set()).add(r.spec_ord)
    assert len({frozenset(v) for v in worlds.values()}) > 300


def test_labels(spark, nodes):
    edges = spark.createDataFrame(
        [(0, "A0", "A1"), (0, "A1", "A2"), (0, "A4", "A2")], "graph_idx bigint, parent string, child string"
    )
    related = closure.related_words(nodes, edges)
    rows = specs.label_specs(specs.observation_specs(nodes, 2), related, 2).collect()
    got = {(r.query_entity, tuple(r.observed_entities)): list(r.inference_types) for r in rows}
    assert got["A1", ("A0",)] == ["ancestor"]
    assert got["A1", ("A0", "A2")] == ["ancestor", "descendant"]
    assert got["A1", ("A2", "A4")] == ["descendant", "independent"]
    assert got["A5", ("A0", "A1")] == ["independent"]
    assert all(r.primary_inference_type == r.inference_types[0] for r in rows)


@pytest.mark.parametrize(
    "bad",
    [
        {"sample_ratio_from_worlds": 1.5}, {"sample_ratio_from_worlds": -0.1}, {"max_observations": -1},
        {"max_explanations": -1}, {"num_copies_explanations": -1}, {"add_instruction_datapoints": -1},
        {"max_observations_per_component_probability_bin": 3}, {"heldout_scope": "worlds"},
        {"per_component_data": True, "max_observations_per_component_probability_bin": -2},
    ],
)
def test_config_guards(bad):
    with pytest.raises(ValueError):
        DatasetConfig(**bad)
