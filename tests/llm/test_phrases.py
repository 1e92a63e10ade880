"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsets.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top, least):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p in candidates:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], f[p])
        found = []
        for p in candidates:
            if p in inside and 100 * inside[p] >= 80 * f[p]:
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, top, least, **more):
    docs = spark.createDataFrame([(i, t, x, "clash", 1) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, word string, a int")
    return sorted(tuple(r) for r in phrases.collocations(docs, top, least, **more).collect())


@pytest.mark.parametrize("top,least", [(4, 3), (60, 5)])
def test_collocations_equal_plain_counting(spark, monkeypatch, top, least):
    monkeypatch.setattr(phrases, "STEP", 10_000)
    rng = random.Random(top)
    words = [f"w{i}" for i in range(25)] + ["Été", "𝔘", "a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(400):
        text = []
        for _ in range(rng.randrange(0, 30)):
            text.append(rng.choices(words, weights)[0] + rng.choice(["", "", "", ",", "\n", "."]))
            if rng.random() < 0.1:
                text.append(rng.choice(["new york city hall", "a a a a a", "red Fox jumps", "red fox sleeps", "one two"]))
        rows.append((" ".join(text), rng.choice(["en", "en", "en", "de", None])))
    rows += [("long tail of words here", "en")] * 40 + [(None, "fr"), ("", "fr"), ("...", None), ("\t \t", "en"), ("lonely", "es")]
    assert mined(spark, rows, top, least) == plain(rows, top, least)


def test_all_tied(spark):
    rows = [(f"x{i} y{i} z{i} u{i} v{i}", "en") for i in range(30)] * 3
    assert mined(spark, rows, 7, 3) == plain(rows, 7, 3)


def test_nothing_to_mine(spark):
    assert mined(spark, [], 5, 3) == []
    assert mined(spark, [("a b", "en"), (None, None)], 5, 3) == []


def test_two_words_of_one_hash_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([("a b", "en")], "text string, lang string")
    words = phrases.word_counts(docs)
    assert {r.word: r.a for r in words.collect()} == {"a": 1, "b": 1}
    monkeypatch.setattr(phrases, "saved", lambda df, name: df.withColumn("h1", F.lit(1)))
    with pytest.raises(ValueError):
        phrases.word_counts(docs)


def test_places_agree(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(2**63), 2**63 - 1, (50, 3))
    df = spark.createDataFrame([tuple(map(int, r)) for r in hashes], "h1 long, h2 long, h3 long")
    got = [r[0] for r in df.select(phrases._place(F.col("h1"), F.col("h2"), F.col("h3"))).collect()]
    assert got == phrases._place(hashes[:, 0], hashes[:, 1], hashes[:, 2]).tolist()
    bits = phrases.bitmap(df, 3)
    assert phrases._has(bits, phrases._place(*hashes.T)).all() and int(np.bitwise_count(bits.view(np.uint64)).sum()) <= 50
