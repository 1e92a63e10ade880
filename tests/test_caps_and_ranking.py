import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphsets.functions.draws import draw
from graphsets import session
from graphsets.operators import caps, ranking, report, saturation


@pytest.fixture(scope="module")
def skewed(spark):
    """A third and more of all rows share one key."""
    return spark.range(0, 6000).select(
        F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        F.col("id").cast("string").alias("row_key"),
        draw(9, "test", "id").alias("d"),
    ).cache()


def in_order(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.d, r.row_key)):
        groups[r.key].append(r.row_key)
    return groups


def test_draw_rank_equals_a_sort(skewed):
    groups = in_order(skewed.collect())
    for r in ranking.draw_ranked(skewed, ["key"], "d", ["row_key"]).collect():
        assert groups[r.key][r["rank"] - 1] == r.row_key and r.group_rows == len(groups[r.key])


@pytest.mark.parametrize("rows", [1, 3, 100, 5000])
def test_buckets_hold_a_bounded_number_of_rows(skewed, monkeypatch, rows):
    """From one row a bucket, where intervals are cut, to one bucket for all, where they are joined."""
    monkeypatch.setattr(ranking, "BUCKET_ROWS", rows)
    cut = ranking.equi_depth(skewed, ["key"], "d", "b").groupBy("key", "b").agg(
        F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")
    ).orderBy("key", "b").collect()
    largest = {"hot": 2500}
    for key in {r.key for r in cut}:
        mine = [r for r in cut if r.key == key]
        assert all(a.high < b.low for a, b in itertools.pairwise(mine))
        assert max(r.n for r in mine) <= max(8, 2 * rows)
        if rows == 5000:
            assert len(mine) == 1 and mine[0].n == largest.get(key, mine[0].n)
    groups = in_order(skewed.collect())
    for r in ranking.draw_ranked(skewed, ["key"], "d", ["row_key"]).collect():
        assert groups[r.key][r["rank"] - 1] == r.row_key


@pytest.mark.parametrize("keep", [0, 1, 7, 100, 9999])
def test_lowest_equals_a_sort(skewed, keep):
    groups = in_order(skewed.collect())
    got = defaultdict(set)
    for r in ranking.lowest(skewed, ["key"], "d", ["row_key"], keep).collect():
        got[r.key].add(r.row_key)
    assert got == {k: set(v[:keep]) for k, v in groups.items() if keep}


@pytest.mark.parametrize("position", [1, 80, 2500, 2501])
def test_nth_row(skewed, position):
    groups = in_order(skewed.collect())
    got = {r.key: r.row_key for r in ranking.nth_row(skewed, ["key"], "d", ["row_key"], position).collect()}
    assert got == {k: v[position - 1] for k, v in groups.items() if len(v) >= position}


def test_equal_draws_fall_back_to_the_key(spark):
    rows = spark.createDataFrame([("a", str(i), 5) for i in range(9)], "key string, row_key string, d bigint")
    got = [r.row_key for r in ranking.lowest(rows, ["key"], "d", ["row_key"], 4).collect()]
    assert sorted(got) == ["0", "1", "2", "3"]


def test_indexed(skewed):
    got = {r.row_key: r.row_idx for r in ranking.indexed(skewed.select("row_key"), ["row_key"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    assert len(got) == 6000


def test_example_index_counts_from_zero_per_split(skewed):
    rows = skewed.withColumnRenamed("key", "split")
    got = defaultdict(list)
    for r in report.example_index(rows, ["row_key"]).collect():
        got[r.split].append((r.row_key, r.example_id))
    for pairs in got.values():
        assert [i for _, i in sorted(pairs)] == list(range(len(pairs)))


def test_cap_by_key_with_null_keys(spark):
    rows = spark.createDataFrame([(None if i % 3 else "a", str(i)) for i in range(30)], "t string, row_key string")
    assert caps.cap_by_key(rows, None, ["t"], "row_key", 1).count() == 30
    assert caps.cap_by_key(rows, 0, ["t"], "row_key", 1).count() == 0
    got = Counter(r.t for r in caps.cap_by_key(rows, 12, ["t"], "row_key", 1).collect())
    assert got == {None: 12, "a": 10}
    with pytest.raises(ValueError):
        caps.cap_by_key(rows, -1, ["t"], "row_key", 1)


LABELS = ["ancestor", "descendant", "independent", "other"]


@pytest.mark.parametrize("seed,cap", [(1, 1), (2, 5), (3, 20), (4, 60), (5, 500), (6, 0)])
def test_multilabel_cap(spark, seed, cap):
    """Sets are cut to prefixes, no label is above the cap, and only full labels drop rows."""
    rng = random.Random(seed)
    data = [
        (rng.choice(["train", "train", "val", None]), rng.sample(LABELS, rng.choice([1, 1, 2, 3])), f"r{i:04d}")
        for i in range(400)
    ]
    rows = spark.createDataFrame(data, "split string, inference_types array<string>, row_key string")
    drawn = {r.row_key: r for r in rows.withColumn("d", draw(3, "cap_labels", "row_key")).collect()}
    got = caps.cap_multilabel(rows, cap, "row_key", 3)
    assert got.columns == rows.columns
    kept = {r.row_key for r in got.collect()}
    place = {k: (r.d, k) for k, r in drawn.items()}
    used = Counter((r.split, label) for k, r in drawn.items() if k in kept for label in r.inference_types)
    assert all(n <= cap for n in used.values())
    sets = defaultdict(list)
    for k, r in drawn.items():
        sets[r.split, tuple(sorted(r.inference_types))].append(k)
    for keys in sets.values():
        inside = [k in kept for k in sorted(keys, key=place.get)]
        assert inside == sorted(inside, reverse=True)
    for k, r in drawn.items():
        if k not in kept:
            earlier = Counter(
                label for e, x in drawn.items() if e in kept and x.split == r.split and place[e] < place[k]
                for label in x.inference_types
            )
            assert any(earlier[label] >= cap for label in r.inference_types)


def greedy(rows, cap):
    """(split, key) of the rows that one scan in draw order keeps."""
    used, kept = Counter(), set()
    for r in sorted(rows, key=lambda r: (r.d, r.row_key)):
        labels = {(r.split, x) for x in r.inference_types}
        if all(used[x] < cap for x in labels):
            used.update(labels)
            kept.add(r.row_key)
    return kept


@pytest.mark.parametrize("fine", [0, 50, 1_000_000])
@pytest.mark.parametrize("labels,cap", [(6, 3), (6, 40), (500, 7)])
def test_saturation_from_counts_equals_a_scan(spark, monkeypatch, fine, labels, cap):
    """From few labels to five hundred, down to the last bit of the draws or taking rows at once; some draws tie."""
    monkeypatch.setattr(saturation, "FINE_ROWS", fine)
    rng = random.Random(labels + cap)
    names = [f"L{i:03d}" for i in range(labels)]
    weights = [1 / (i + 1) for i in range(labels)]
    data = [
        (rng.choice(["train", "train", "val"]), list(set(rng.choices(names, weights, k=rng.choice([1, 2, 3])))), f"r{i:05d}")
        for i in range(3000)
    ]
    rows = spark.createDataFrame(data, "split string, inference_types array<string>, row_key string").withColumn(
        "d", F.when(F.xxhash64("row_key") % 10 == 0, F.lit(1 << 50).cast("bigint")).otherwise(draw(3, "any", "row_key"))
    ).cache()
    steps, written = [], session._written
    monkeypatch.setattr(session, "_written", lambda *a: steps.append(a) or written(*a))
    points = saturation.saturation_points(rows, cap, "split", "inference_types", "d", "row_key").collect()
    assert len(steps) <= (8 if fine == 1_000_000 else 20)
    at = {(r.split, r.label): tuple(r["at"]) for r in points}
    assert len(at) == len(points)
    every = rows.collect()
    late = (1 << 60, "")
    kept = {r.row_key for r in every if all((r.d, r.row_key) <= at.get((r.split, x), late) for x in r.inference_types)}
    assert kept == greedy(every, cap)
    used = Counter((r.split, x) for r in every if r.row_key in kept for x in r.inference_types)
    assert {x for x, n in used.items() if n == cap} == set(at)


def test_rows_without_labels_count_for_their_primary_type(spark):
    data = [("train", [], "a", f"r{i}") for i in range(5)] + [("train", None, "a", f"s{i}") for i in range(3)]
    data += [(None, [None], "b", "t"), (None, ["b"], "x", "u"), ("val", None, None, "v")]
    rows = spark.createDataFrame(
        data, "split string, inference_types array<string>, primary_inference_type string, row_key string"
    )
    got = caps.cap_multilabel(rows, 3, "row_key", 1).collect()
    assert Counter(r.primary_inference_type for r in got) == {"a": 3, "b": 1, "x": 1, None: 1}
    assert caps.cap_multilabel(rows, 1, "row_key", 1).filter("split is null").count() == 1


def test_repeated_row_keys_are_an_error(spark):
    rows = spark.createDataFrame([("train", ["a"], "r")] * 2, "split string, inference_types array<string>, row_key string")
    with pytest.raises(ValueError):
        caps.cap_multilabel(rows, 1, "row_key", 1)


def test_null_groups_stay(spark):
    rows = spark.createDataFrame(
        [(None if i % 2 else "a", str(i), i) for i in range(6)], "split string, row_key string, d bigint"
    )
    assert ranking.draw_ranked(rows, ["split"], "d", ["row_key"]).count() == 6
    assert sorted(r.example_id for r in report.example_index(rows, ["row_key"]).collect()) == [0, 0, 1, 1, 2, 2]
    for keep in (1, 20_000):
        got = Counter(r.split for r in ranking.lowest(rows, ["split"], "d", ["row_key"], keep).collect())
        assert got == {None: min(keep, 3), "a": min(keep, 3)}
    assert {r.d for r in ranking.nth_row(rows, ["split"], "d", ["row_key"], 2).collect()} == {2, 3}


def observation(i, query, value, answer, split="train", component=0):
    return (0, component, query, ["A"], [value], answer, split, f"r{i}")


OBS = "graph_idx bigint, component_id bigint, query_entity string, observed_entities array<string>, " \
      "observed_values array<string>, answer string, split string, row_key string"


def test_probability_bins(spark):
    data = [observation(i, "Q", "1", "1") for i in range(3)] + [observation(3, "Q", "1", "0")]
    data += [observation(4, "R", "0", "0"), observation(5, "Z", "0", "1", split="val")]
    data += [observation(6, "Q", "1", "1", split="val")]
    got = {r.row_key: r.probability_bin for r in caps.probability_bins(spark.createDataFrame(data, OBS)).collect()}
    assert got == {"r0": "7", "r1": "7", "r2": "7", "r3": "2", "r4": "9", "r5": "unobserved", "r6": "7"}


def test_component_bin_cap_with_nulls(spark):
    data = [observation(i, "Q", "1", "1", split=None) for i in range(3)]
    data += [observation(i, "Q", "1", "1", component=None) for i in range(3, 8)]
    rows = spark.createDataFrame(data, OBS)
    got = Counter((r.split, r.component_id) for r in caps.cap_component_bin(rows, 2, "row_key", 1).collect())
    assert got == {(None, 0): 3, ("train", None): 2}


def test_component_bin_cap_passes_other_splits(spark):
    data = [observation(i, "Q", "1", "1") for i in range(9)] + [observation(9, "Q", "1", "0")]
    data += [observation(i, "Q", "1", "1", split="val") for i in range(10, 16)]
    rows = spark.createDataFrame(data, OBS)
    got = caps.cap_component_bin(rows, 2, "row_key", 1)
    assert got.columns == rows.columns
    assert Counter((r.split, r.answer) for r in got.collect()) == {("train", "1"): 2, ("train", "0"): 1, ("val", "1"): 6}
    assert caps.cap_component_bin(rows, None, "row_key", 1).count() == 16


def test_shuffle_is_a_permutation(skewed):
    got = {r.row_key: r.position for r in report.seeded_shuffle(skewed.select("row_key"), "row_key", 4).collect()}
    assert sorted(got.values()) == list(range(6000))
    other = {r.row_key: r.position for r in report.seeded_shuffle(skewed.select("row_key"), "row_key", 5).collect()}
    assert got != other


@pytest.mark.parametrize("n,size", [(10, 20), (20, 20), (21, 20), (59, 20), (60, 20), (1000, 7)])
def test_stride_sample(spark, n, size):
    rows = spark.range(0, n)
    got = sorted(r.id for r in report.stride_sample(rows, ["id"], size).collect())
    assert got == (list(range(n)) if n <= size else list(range(0, n, max(1, n // size)))[:size])


def test_stride_sample_sorts_keys_only_and_counts_ties(spark, monkeypatch):
    rows = spark.createDataFrame([(None if i < 5 else i // 4, i, "text") for i in range(120)], "k int, v int, wide string").repartition(4)
    seen = []
    monkeypatch.setattr(report, "indexed", lambda df, *more: seen.append(df.columns) or ranking.indexed(df, *more))
    got = sorted(r.v for r in report.stride_sample(rows, ["k"], 40).collect())
    assert seen == [["k"]] and got == list(range(0, 120, 3))


@pytest.mark.parametrize("n", [1, 2, 4, 19, 20, 21, 100])
def test_length_percentiles(spark, n):
    rng = random.Random(n)
    lengths = [rng.randrange(30) for _ in range(n)]
    rows = spark.createDataFrame([("w " * x, "") for x in lengths], "prompt string, completion string")
    got = {r.part: r for r in report.length_stats(rows).collect()}["prompt"]
    xs = sorted(lengths)
    assert (got.n, got.min_len, got.max_len) == (n, xs[0], xs[-1])
    assert got.p50_len == xs[n // 2] and got.p95_len == xs[int(0.95 * n) - 1]
    assert abs(got.avg_len - sum(xs) / n) < 1e-9


def test_lengths_per_split_and_without_completions(spark):
    rows = spark.createDataFrame([("a", "x y"), ("a", "x"), ("b", "x y z"), (None, "")], "split string, prompt string")
    got = {(r.split, r.part): (r.n, r.min_len, r.max_len) for r in report.length_stats(rows, completion=None, by=("split",)).collect()}
    assert got == {("a", "prompt"): (2, 1, 2), ("b", "prompt"): (1, 3, 3), (None, "prompt"): (1, 0, 0)}


def test_eval_subset(spark):
    rows = spark.range(0, 50).withColumnRenamed("id", "example_id")
    got = [r.example_id for r in report.eval_subset(rows, 10, "example_id", 1).collect()]
    assert len(got) == 10 and got == sorted(got)
    assert report.eval_subset(rows, 99, "example_id", 1).count() == 50
