"""Line labels: counts against plain ones, the chain against all labellings, the verdict on held-out rows."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsets.llm import linecrf, queries
from graphsets.llm.langid import held_out

SPACE = "[\x20\x09-\x0d]"
LONG = "word other thing " * 30_000


def plain(text):
    text = text or ""
    words = [w for w in re.split(f"{SPACE}+", text) if w]
    lines = text.split("\n")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + s for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for s in range(3)}
    dup = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def test_counts_equal_plain_ones(spark):
    rng = random.Random(2)
    words = ["a", "b", "ä€", "𝔘#", "$|", "Ab.", "x1"]
    texts = [None, "", "\n", "\n\n a\n a\na", " \x0b\x0c\r\t", LONG, "a b c " * 20, "α\nα\n\nα", "a b   c"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(120))) for _ in range(150)]
    rows = [(i, t, "clash", 3, True) for i, t in enumerate(texts)] + [(None, "same", "x", 1, False), (5, "again", "x", 1, None), (5, "again", "x", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int, kept boolean").repartition(3)
    got = linecrf.label_lines(docs, None)
    assert got.columns[:3] == ["doc_id", "text", "words"]
    for row in got.collect():
        counts = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)
        assert counts == plain(row.text), row.text
        assert row.kept is (not row.base_failed) and row.content_words == row.n_words
        assert len(row.is_content) == len((row.text or "").split("\n"))
    assert got.count() == len(rows)


def every_labelling(unary, links):
    for labels in itertools.product((0, 1), repeat=len(unary)):
        yield labels, sum(u for u, x in zip(unary, labels, strict=True) if x) + sum(links[a][b] for a, b in itertools.pairwise(labels))


def test_chain_against_all_labellings():
    rng = np.random.default_rng(4)
    for n in range(1, 9):
        unary, links = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        scored = dict(every_labelling(unary.tolist(), links.tolist()))
        assert tuple(linecrf.viterbi(unary, links)) == max(scored, key=scored.get)
        padded = np.concatenate([unary, np.zeros(3)])[None]
        mask = (np.arange(n + 3) < n)[None]
        content, pairs, total = linecrf.marginals(padded, mask, links)
        z = sum(np.exp(s) for s in scored.values())
        assert total == pytest.approx(np.log(z))
        for t in range(n):
            assert content[0, t] == pytest.approx(sum(np.exp(s) for x, s in scored.items() if x[t]) / z)
        for a, b in itertools.product((0, 1), repeat=2):
            want = sum(np.exp(s) * list(itertools.pairwise(x)).count((a, b)) for x, s in scored.items()) / z
            assert pairs[a, b] == pytest.approx(want)


def corpus(spark, n=240):
    rng = random.Random(9)
    say = lambda k: " ".join(rng.choice(["river", "stone", "walks", "over", "green", "hills"]) + rng.choice(["", "", "."]) for _ in range(k)) + "."
    menu = lambda k: " | ".join(rng.choice(["HOME", "LOGIN", "CART", "HELP"]) + str(rng.randrange(999)) for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        good = i % 2 == 0
        lines = [say(rng.randrange(25, 40)).capitalize() for _ in range(4 if good else 1)] + [menu(rng.randrange(12, 20)) for _ in range(1 if good else 6)]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    docs += [(None, "x"), (1, None), (n, ""), (n + 1, LONG), (2, docs[2][1])]
    labels += [(None, 0), (3, None), (2, 1), (9_999, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_verdict_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = linecrf.judge(docs, labels).withColumn("held", held_out(F.col("doc_id"))).collect()
    tested = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 240 and not r.base_failed and r.n_words]
    assert len(tested) > 40
    assert all(r.kept == (r.doc_id % 2 == 0) for r in tested)
    mixed = [r for r in tested if not r.kept]
    # The sentence of a bad document is content.
    assert sum(any(r.is_content) for r in mixed) > 0.8 * len(mixed)
    again = linecrf.judge(docs, labels).select("doc_id", "content_words").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in linecrf.judge(docs, labels).select("doc_id", "content_words").collect())


def test_without_labels_only_the_base_decides(spark):
    docs, labels = corpus(spark, 40)
    for few in (labels.limit(0), labels.filter("quality = 1")):
        assert linecrf.judge(docs, few).filter("kept = base_failed").count() == 0
    assert linecrf.judge(docs.limit(0), labels).count() == 0


def test_query_keeps_clean_documents(spark, sf_dir):
    from graphsets.llm.queries import table

    found = queries.op13_line_quality(spark, sf_dir)
    assert found.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert found.count() == table(spark, sf_dir, "documents").count()
    judged = found.filter("not base_failed").join(table(spark, sf_dir, "labels"), "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in judged if r.quality == 1]
    assert sum(good) >= 0.97 * len(good)
