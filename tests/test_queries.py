import os

import pytest

import __spark_entry__ as entry_module
from checks import compare, oracles, queries
from graphsets.plans import tables as star
from graphsets.sources import jsonl

QUERIES = queries.queries()
SQL = oracles.oracle_sql()


NO_SQL = {"token_length_stats", "token_overflow"}  # DuckDB has no tokenizer; held against the library below


def test_every_query_has_sql():
    assert set(QUERIES) - NO_SQL == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, sf_dir, connection, name):
    assert compare.difference(QUERIES[name](spark, sf_dir), connection, SQL[name]) is None


def test_token_queries_equal_the_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = star.instructions(spark, sf_dir).collect()
    size = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    sizes = {"prompt": [size(r.instruction) for r in rows], "completion": [size(r.output) for r in rows]}
    sizes["total"] = [a + b for a, b in zip(sizes["prompt"], sizes["completion"], strict=True)]
    for r in QUERIES["token_length_stats"](spark, sf_dir).collect():
        every = sorted(sizes[r.part])
        assert (r.n, r.min_len, r.max_len, r.p50_len) == (len(every), every[0], every[-1], every[len(every) // 2])
        assert r.avg_len == pytest.approx(sum(every) / len(every), abs=1e-6)
    want = {(r.conv_id, r.turn, size(r.instruction)) for r in rows if size(r.instruction) > 60}
    assert {tuple(r) for r in QUERIES["token_overflow"](spark, sf_dir).collect()} == want and want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_no_train_explanation_names_a_held_out_entity(spark, sf_dir):
    from checks.queries import tables

    t = tables(spark, sf_dir)
    held = {r.entity for r in t.builder().splits().filter("split <> 'train'").collect()}
    rows = t.examples().filter("kind = 'explanation' AND split = 'train'").select("query_entity").distinct().collect()
    assert not any(e in held for r in rows for e in r.query_entity.split("->"))


def test_empty_splits_are_written(spark, sf_dir, tmp_path):
    from checks.queries import tables

    path = str(tmp_path / "train-only")
    rows = tables(spark, sf_dir).examples().filter("split = 'train' AND kind = 'instruction'")
    jsonl.write_splits(rows, path)
    assert all(os.path.isdir(jsonl.split_folder(path, s)) for s in ("train", "val", "test"))
    back = jsonl.scan_examples(spark, path)
    assert back.count() == rows.count() and back.columns == sorted(back.columns)
    assert {r.observed_entities == [] for r in back.collect()} == {True}
