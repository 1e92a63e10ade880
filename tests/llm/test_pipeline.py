"""The pipeline and the queries on small directories."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from graphsets.llm import queries as llm
from graphsets.llm import records


def test_each_stage_on_odd_tables(spark, docs, sf):
    rows = [
        (1, "a small text about nothing much at all", "en", "s1", 3), (2, None, "en", "s1", 1), (3, "", None, None, None),
        (4, "a small text about nothing much at all", "en", "s2", 3), (4, "a small text about nothing much at all", "en", "s2", 3),
        (None, "another text that is quite different from the first one", "en", None, 2), (6, "word " * 20000, "en", "s1", 9),
        (7, "who can say how many birds sat on the long wire that day", "en", "s1", 9),
    ]
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "Who can say how many birds sat on the long wire that day?")], "item_id long, text string")
    path = sf(documents=docs(rows, extra=False), labels=labels, benchmark=benchmark)
    df = docs(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, path)
        if name != "token_records":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        ids = [r["doc_id"] for r in out.collect()]
        if name == "language_id":
            assert not {2, 3} & set(ids) and len(ids) == 6
        elif name == "ngram_jaccard_join":
            assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, None, 6, 7]))
        elif name == "benchmark_decontamination":
            assert len(ids) == 7 and 7 not in ids
        elif name == "source_mixing":
            assert max(Counter(ids).values()) <= 6
        else:
            assert len(ids) == len(rows)
        assert stage(spark, df.limit(0), path).count() == 0
    assert corpus_pipeline.run(spark, path).count() > 0


def test_pipeline_against_plain_steps(spark, sf_dir):
    """Every document is accounted for by plain versions of the stages."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in docs.items()}
    shingles = {d: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for d, w in words.items() if w}
    first = {}
    for d in sorted(shingles):
        near = [f for f in first if len(shingles[f] & shingles[d]) >= 0.8 * len(shingles[f] | shingles[d])]
        first[d] = first[near[0]] if near else d
    flat = [" " + " ".join(re.findall(r"[^\W_]+", i.lower())) + " " for i in items]
    kept = {f for f in first.values() if not any(i in " " + " ".join(words[f]) + " " for i in flat)}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(records.session_tokenizer())
    rows = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert {r["doc_id"] for r in rows} <= kept
    assert len({r["doc_id"] for r in rows}) > 0.5 * len(kept)
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    from checks.compare import difference, duck

    assert difference(llm.queries()[name](spark, sf_dir), duck(sf_dir), llm.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_covers_its_table(spark, sf_dir, name):
    got = llm.queries()[name](spark, sf_dir)
    docs = duckdb.sql(f"select count(*) from '{sf_dir}/documents.parquet'").fetchall()[0][0]
    if name not in ("pipeline", "op8_decontamination"):
        assert got.count() == docs and got.select("doc_id").distinct().count() == docs
    else:
        assert 0 < got.count()
