"""Steps whose shuffles, sorts and written tables follow what is asked for; results equal the plain ways."""

import gzip
import itertools
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from checks.queries import tables
from graphsets import session
from graphsets.functions import combinations
from graphsets.functions.draws import draw
from graphsets.operators import caps, closure, examples, graph, ranking, report, specs
from graphsets.operators.pairing import near_join
from graphsets.plans import tables as star
from graphsets.plans.dataset import prepare_nodes
from graphsets.schema import EXAMPLE_SCHEMA
from graphsets.sources import jsonl


def bag(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


def row_shuffles(df):
    """Exchanges in the plan as it is before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_few_draws_are_made_in_the_row_of_their_world(spark, monkeypatch):
    counts = spark.createDataFrame([(0, 40), (1, 7), (2, 1)], "graph_idx bigint, n bigint")
    for ratio in (0.1, 0.3, 0.9):
        at_once = bag(specs.sample_per_world(counts, 5, ratio, 3))
        monkeypatch.setattr(specs, "FEW_TRIES", 0)
        assert bag(specs.sample_per_world(counts, 5, ratio, 3)) == at_once
        monkeypatch.undo()
    groups = counts.selectExpr("graph_idx", "n", "0L AS world_id", "1L AS want", "9L AS tries")
    assert row_shuffles(specs._drawn_at_once(groups, 3)) == 1


def test_lookups_of_small_graphs_share_one_shuffle(spark):
    # Node 2 comes twice, and graph 1 has nodes without relatives.
    nodes = spark.createDataFrame(
        [(g, f"N{g}{i}", i) for g in (0, 1) for i in (0, 1, 2, 2, 3)], "graph_idx bigint, entity string, ord bigint"
    )
    edges = spark.createDataFrame([(0, "N00", "N01"), (0, "N01", "N03")], "graph_idx bigint, parent string, child string")
    related = closure.related_words(nodes, edges)
    words = session.durable(nodes.distinct().select("graph_idx", "entity", F.lit(0).alias("word"), (F.col("ord") * 5).alias("bits")))
    placed = session.durable(specs.placed_nodes(nodes))
    queries = session.durable(specs.spec_queries(placed, 2))
    numbers = session.durable(specs._numbers(specs.spec_counts(queries)).withColumn("world_id", F.lit(2).cast("bigint")))

    def made(near):
        found = specs.unrank_specs(numbers, placed, queries, 2, near=near)
        return examples.observe(specs.label_specs(found, session.durable(related), 2, near), words, 2, near)

    assert bag(made(True)) == bag(made(False)) and made(True).count() > 0
    # The rows, the ranges, and a table for each slot; dealt by other columns, the rows would move for each slot too.
    assert row_shuffles(made(True)) == 1 + 1 + 2 + 2 + 3


def test_data_set_is_not_written_before_it_is_read(spark, sf_dir, monkeypatch):
    written = []
    plain = session._written
    monkeypatch.setattr(session, "_written", lambda df, by: (written.append(set(df.columns)), plain(df, by))[1])
    rows = star.Tables(spark, sf_dir).examples()
    assert report.split_kind_counts(rows).count() > 0
    assert written and not any("prompt" in columns or "explanation_type" in columns for columns in written)


def test_first_rows_sort_only_those_with_the_least_lead(spark):
    texts = [("a", "o|10|zz"), ("a", "o|10|z"), ("a", "o|1"), ("a", None), (None, "é"), (None, "z"), ("b", None), ("c", "abcdefgh1"), ("c", "abcdefgh0")]
    df = spark.createDataFrame([(s, k, f"p{k}") for s, k in texts], "split string, row_key string, prompt string")
    groups, least = ranking.least_led(df, ["split"], "row_key")
    assert {r.split: r.n for r in groups.collect()} == {"a": 4, None: 2, "b": 1, "c": 2}
    assert sorted(r.row_key for r in least.collect()) == ["abcdefgh0", "abcdefgh1", "o|1", "z"]
    shown = report.split_preview(df.withColumn("completion", F.col("prompt")).withColumn("answer", F.col("prompt")))
    assert {(r.split, r.n, r.prompt) for r in shown.collect()} == {("a", 4, "po|1"), (None, 2, "pz"), ("b", 1, None), ("c", 2, "pabcdefgh0")}


def test_thinned_rows_are_the_lowest_whatever_the_size_says(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("k"), draw(1, "t", "id").alias("d")
    )
    want = bag(ranking.lowest(df, ["g"], "d", ["k"], 4))
    for size in (1, 1000, 10**9, None):  # too small, right, far too large, unknown
        sized = df.withColumn("size", F.lit(size).cast("bigint"))
        assert bag(ranking.lowest_thinned(sized, ["g"], "d", ["k"], 4, "size").drop("size")) == want


def test_bins_counted_within_graphs_equal_joined_ones(spark):
    schema = "graph_idx bigint, query_entity string, observed_entities array<string>, observed_values array<string>, answer string, split string"
    rows = [(i % 2, f"Q{i % 3}", ["A"], ["1" if i % 5 else "0"], str(i % 7 // 5), "train" if i % 4 else "val") for i in range(90)]
    rows += [(0, None, ["A"], ["1"], "1", "train"), (1, "Q9", ["B"], None, "0", "train"), (1, "Q9", ["B"], ["1"], "0", None)]
    df = spark.createDataFrame(rows, schema)
    assert bag(caps.probability_bins(df, near=True)) == bag(caps.probability_bins(df))
    assert bag(caps.conditional_probability(df, near=True)) == bag(caps.conditional_probability(df))
    assert "Join" not in caps.probability_bins(df, near=True)._jdf.queryExecution().executedPlan().toString()


def test_json_lines_are_compressed(spark, sf_dir, tmp_path):
    rows = star.Tables(spark, sf_dir).builder().explanation_rows().limit(20)
    jsonl.write_splits(examples.render_explanations(rows), str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files if f.stat().st_size)
    assert jsonl.scan_examples(spark, str(tmp_path / "out")).count() == 20


def test_edges_move_lines_once_and_equal_the_plain_way(spark, tmp_path):
    days = ["1995-01-01", "1995-01-02", None]
    rows = [(p, days[(p * 7 + i) % 3], "ANR"[i % 3] if i % 5 else None) for p in (0, 1, 2, 7, 19, 20, 39, 41, None, -1, -3) if p is not None for i in range(6)]
    rows += [(None, "1995-01-01", "A")] * 3 + rows[:4]
    spark.createDataFrame(rows, "l_partkey bigint, l_shipdate string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want, groups = set(), {}
    for part, day, flag in rows:
        if part is not None:
            groups.setdefault((part // star.BLOCK, day, flag), set()).add(part)
    for (graph, _, _), parts in groups.items():
        ordered = sorted(parts)
        want |= {(graph, f"P{str(a).rjust(9, '0')}", f"P{str(b).rjust(9, '0')}") for a, b in zip(ordered, ordered[1:])}
    found = star.edges(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_lookups_dealt_once_are_by_hash(spark):
    rows = spark.createDataFrame([(g, e, i) for i in range(3) for g in (0, 1, None) for e in ("a", "b", "c", None)], "g bigint, e string, i int")
    table = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (0, "b", 3), (1, "c", 4), (None, "a", 5), (1, None, 6)], "g bigint, e string, v int")
    for how in ("inner", "left"):
        plain = near_join(rows, table, "g", ["e"], how)
        with session.dealt_once(spark):
            once = near_join(near_join(rows, table, "g", ["e"], how), table.withColumnRenamed("v", "w"), "g", ["e"], how)
            assert row_shuffles(once) == 3 and "ShuffledHashJoin [g" in (plan := once._jdf.queryExecution().executedPlan().toString()) and "e#" in plan.split("ShuffledHashJoin [", 1)[1].split("]", 1)[0]
            assert " >= " not in plan
            found = bag(once)
        assert found == bag(near_join(plain, table.withColumnRenamed("v", "w"), "g", ["e"], how))
    assert not session.is_dealt_once(spark)


def test_observed_rows_of_small_graphs_are_looked_up_by_hash(spark, sf_dir, monkeypatch):
    builder = star.Tables(spark, sf_dir).builder()
    seen = []
    plain = examples.observe
    monkeypatch.setattr(examples, "observe", lambda *a: (seen.append((a[3], session.is_dealt_once(spark))), plain(*a))[1])
    related, words = builder.related(), builder.words()
    rows = builder.observed()
    assert seen == [(True, True)] and not session.is_dealt_once(spark)
    found = specs.unrank_specs(builder.sampled(), builder.placed(), builder.queries(), 2, near=True)
    assert bag(rows) == bag(plain(specs.label_specs(found, related, 2, True), words, 2, True))


def test_specs_are_unranked_and_labelled_without_lambdas(spark):
    counts = spark.range(2, 9).crossJoin(spark.createDataFrame([(1,), (2,)], "size bigint")).withColumnRenamed("id", "n")
    numbers = counts.withColumn("rank", F.explode(F.expr("sequence(0L, if(size = 1, n, n * (n - 1) div 2) - 1)")))
    made = combinations.unrank_sets(numbers, F.col("rank"), "n", "size", 2, "places")
    for n in range(2, 9):
        for size in (1, 2):
            rows = made.filter((F.col("n") == n) & (F.col("size") == size)).orderBy("rank").collect()
            assert [tuple(r.places) for r in rows] == list(itertools.combinations(range(n), size))
    names = ["descendant", "independent", "ancestor", None]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    typed = pairs.withColumn("types", specs.prioritised(["a", "b"]))
    for r in typed.collect():
        assert r.types == ([x for x in ("ancestor", "descendant", "independent") if x in (r.a, r.b)] or ["independent"])
    for df in (made, typed):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_join_sides_that_grow_are_not_sent_to_the_driver(spark, monkeypatch):
    """Every join says how it is made, so Spark broadcasts nothing because its files look small."""
    plans, plain = [], session._written

    def planned(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(session, "_written", lambda df, by: plain(planned(df), by))
    nodes = spark.createDataFrame([(g, f"N{g}{i}", i) for g in (0, 1) for i in range(5)], "graph_idx bigint, entity string, ord bigint")
    edges = spark.createDataFrame([(g, f"N{g}{a}", f"N{g}{b}") for g in (0, 1) for a, b in ((0, 1), (1, 3), (0, 2), (2, 3))], "graph_idx bigint, parent string, child string")
    made = prepare_nodes(nodes, edges, 0.5, 1)
    related = session.durable(closure.related_words(made, edges))
    counts = planned(closure.relative_counts(nodes, related, "down", "descendants"))
    assert {r.entity: r.descendants for r in counts.filter("graph_idx = 1").collect()} == {"N10": 3, "N11": 1, "N12": 1, "N13": 0, "N14": 0}
    splits = nodes.select("graph_idx", "entity", F.lit("train").alias("split"))
    rows = planned(examples.train_explanation_copies(examples.explanation_rows(made, edges, related, splits, 1), 2))
    assert rows.count() == 3 * 2 * (5 + 3 + 3 + 5 * 4)
    planned(graph.root_nodes(nodes, edges))
    planned(graph.candidate_edges(nodes, []))
    joins = [line for plan in plans for line in plan.splitlines() if re.search(r"\bJoin [A-Z]", line)]
    assert len(joins) > 20 and not [line for line in joins if "strategy=" not in line]
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    large = nodes.join(session.small_side(made.select("graph_idx", "rule")), "graph_idx")
    assert "Hint=(strategy=merge)" in large._jdf.queryExecution().optimizedPlan().toString()


def raising(spark, first, count=3):
    """Rows from two sides whose texts can be made for the rows named ``first`` only."""
    rows = [("train", "observation", f"o|{i}", ["ancestor"] if i % 2 else ["descendant", "ancestor"], None) for i in range(count)]
    rows += [("val", "observation", None, ["independent"], None), (None, "observation", "o|7", [], None)]
    said = [(s, "explanation", f"e|{i}|{t}", ["rule_explanation"], t) for i in range(count) for s in ("train", "val", None) for t in ("rule", None)]
    schema = "split string, kind string, row_key string, inference_types array<string>, explanation_type string"
    # The key of any other row is no number, so its texts are errors.
    texts = {
        name: F.when(F.col("row_key").isin(first), F.concat(F.lit("p "), "row_key")).otherwise(F.col("row_key").cast(kind).cast("string"))
        for name, kind in (("prompt", "int"), ("completion", "bigint"), ("answer", "double"))
    }
    sides = [spark.createDataFrame(side, schema).withColumns(texts) for side in (rows, said)]
    return sides[0].unionByName(sides[1])


def test_texts_are_made_for_the_first_rows_of_types_only(spark):
    rows = raising(spark, ["o|0", "e|0|rule", "e|0|None"])
    found = {(r.split, r.kind, r.type, r.row_key, r.prompt) for r in report.first_example_per_type(rows).collect() if r.row_key}
    assert found == {
        ("train", "observation", "ancestor", "o|0", "p o|0"), ("train", "observation", "descendant", "o|0", "p o|0"),
        ("train", "explanation", "rule", "e|0|rule", "p e|0|rule"), ("val", "explanation", "rule", "e|0|rule", "p e|0|rule"),
    }


def test_texts_are_made_for_the_first_rows_of_splits_only(spark):
    rows = raising(spark, ["e|0|None"])
    found = {(r.split, r.n, r.prompt) for r in report.split_preview(rows).collect()}
    assert found == {("train", 9, "p e|0|None"), ("val", 7, "p e|0|None"), (None, 7, "p e|0|None")}


def test_rows_are_written_by_split_without_a_sort(spark, tmp_path, monkeypatch):
    splits = ["train", "val", "test", "x", "y", None]  # more than files are open at once
    rows = [(f"a{i}", "c", None, i, ["t"], "observation", [], [], "t", f"p {i}", "q", splits[i % 6]) for i in range(60)]
    made = spark.createDataFrame(rows, EXAMPLE_SCHEMA)
    jsonl.write_splits(made, str(tmp_path / "out"))
    back = jsonl.scan_examples(spark, str(tmp_path / "out"), ("train", "val", "test", "x", "y", "__HIVE_DEFAULT_PARTITION__"))
    assert bag(back) == bag(made.select(*back.columns)) and back.count() == 60

    seen = []
    plain = DataFrameWriter.json
    monkeypatch.setattr(DataFrameWriter, "json", lambda self, *a, **k: (seen.append(spark.conf.get(session._OPEN_FILES)), plain(self, *a, **k))[1])
    jsonl.write_splits(made.filter("split in ('train', 'val', 'test')"), str(tmp_path / "few"))
    assert seen == ["4"] and spark.conf.get(session._OPEN_FILES) == "0"  # Spark sorts by folder only where this is 0


def test_lines_are_packed_quickly(spark, tmp_path):
    rows = [(f"a{i}", "c", None, i, ["t"], "observation", [f"P{i * 7919 % 5000}"], ["1"], "t", f"p {i * 31 % 977}", "q", "train") for i in range(3000)]
    jsonl.write_splits(spark.createDataFrame(rows, EXAMPLE_SCHEMA).coalesce(1), str(tmp_path / "out"))
    [file] = (tmp_path / "out" / "part=train").glob("*.json.gz")
    lines = gzip.decompress(file.read_bytes())

    def packed(level):
        return len(zlib.compress(lines, level))

    size = file.stat().st_size
    assert abs(size - packed(2)) < abs(size - packed(6))


def test_least_texts_are_kept_by_hash(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "b"), (None, "c"), ("b", None)], "g string, t string")
    found = df.groupBy("g").agg(ranking.hashed_count().alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))
    assert {tuple(r) for r in found.collect()} == {("a", 2, "b", "x"), (None, 1, "c", "c"), ("b", 1, None, None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "ObjectHashAggregate" in plan
    assert df.filter("g = 'z'").agg(ranking.hashed_count().alias("n")).first().n == 0


def test_facts_are_stated_before_there_is_a_row_for_each_wording(spark, sf_dir):
    builder = tables(spark, sf_dir).builder()
    rows = builder.observation_rows()
    plan = examples.render_observations(rows)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    wordings = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    stated = [i for i, line in enumerate(plan) if "zip_with" in line]
    assert stated and min(stated) > wordings and not any("Join" in line for line in plan)
    plain = examples.observation_rows(builder.observed(), 10)
    assert bag(examples.render_observations(rows)) == bag(examples.render_observations(plain))


def test_copies_are_made_before_texts(spark, sf_dir):
    builder = tables(spark, sf_dir).builder()
    plain = examples.train_explanation_copies(examples.render_explanations(builder.explanation_rows()), 1)
    made = builder.examples().filter("kind = 'explanation'")
    assert bag(made) == bag(plain)
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {name: min(line.index(name) for line in plan if name in line) for name in ("Union", "Generate explode", "Project [")}
    assert sum("Union" in line for line in plan) == 1 and depth["Union"] < depth["Generate explode"]
    capped = tables(spark, sf_dir).builder(max_explanations=50)
    assert len(capped.capped_explanations()) == 1 and len(builder.capped_explanations()) == 4
    want = examples.train_explanation_copies(examples.render_explanations(capped.capped()[1]), 1)
    assert bag(capped.examples().filter("kind = 'explanation'")) == bag(want)
