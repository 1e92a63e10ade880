"""Ranked lexical search against a plain search, and where accumulators stop."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from graphsets.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, counts in held:
            m = 50 + (50 * counts.total() * n_docs) // n_terms
            score = sum(
                floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m))
                for t in set(TERM.findall((text or "").translate(UPPER))) if counts[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k, **sizes):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int")
    items = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, n long")
    return sorted((tuple(r) for r in lexical.search_documents(docs, items, k, **sizes).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 7, "block_terms": 30}])
def test_search_equals_plain_search(spark, sizes):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "ÉTÉ", "été", "𝔘x", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))) for i in range(300)]
    docs += [(None, "w1 w39"), (None, "w1 w39"), (7, "w39"), (7, "w39"), (400, None), (401, ""), (402, " .,"), (403, "W39-w39\x00w38")]
    docs += [(500 + i, "same same text w5") for i in range(60)] + [(600, "w1 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(20)]
    items += [(50, None), (51, "..."), (52, "unknown"), (53, "same"), (None, "w39 w2"), (54, "w0"), (54, "w0 w1")]
    assert searched(spark, docs, items, 5, **sizes) == plain(docs, items, 5)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")], 5) == []
    assert searched(spark, [(1, "a")], [], 5) == []
    assert searched(spark, [(1, "..")], [(1, "a")], 5) == []


def test_terms_of_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 5)
    assert lexical.term_counts("Abc defghijkl, mn abc" + " x" * 9) == {b"abc": 2, b"defghijkl": 1, b"mn": 1, b"x": 9}


def test_no_accumulators_beyond_the_bound():
    # Two documents hold the rare term; the frequent one can't lift the others above them.
    n = 1000
    terms = np.concatenate([np.zeros(2, np.int64), np.ones(n, np.int64)])
    owners = np.concatenate([[5, 9], np.arange(n)])
    adds = np.concatenate([[100, 100], np.arange(n) % 50])
    shard = lexical.Shard(np.arange(n), np.zeros(n, bool), terms, owners, adds)
    found, score, made = shard.search(np.array([0, 1]), 2, 0)
    assert made == 2 and dict(zip(found.tolist(), score.tolist(), strict=True)) == {5: 105, 9: 109}
    assert shard.search(np.array([0, 1]), 3, 0)[2] == n
    assert shard.search(np.array([0, 1]), 3, 149)[2] == 2  # the level of another shard
    assert shard.search(np.array([0, 1]), 3, 200)[2] == 0
