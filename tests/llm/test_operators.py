"""Operators on small tables with nulls, empty and long texts, ties, repeated and no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsets.llm import decontam, jaccard, langid, lines, maxscore, mixing, records, shards, toxicity, warc

LONG = "word " * 20_000


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


ODD = [(1, "b"), (2, None), (3, ""), (None, "x"), (4, LONG), (5, "same"), (5, "same"), (5, "other"), (6, "ä€𝔘\nline")]


# Revisits

RECORD = "record_id long, url string, type string, captured_at long, etag string, last_modified string, headers map<string,string>, payload string"


def plain_revisits(records_):
    out = []
    for rid, key, kind, at, etag, modified, *_ in records_:
        if kind != "revisit":
            continue
        earlier = [
            (r[3], r[0], r[4], r[5]) for r in records_
            if r[2] == "response" and key is not None and r[1] == key and at is not None and r[3] is not None and r[3] < at
        ]
        if not earlier:
            out.append((rid, None, "unmatched"))
            continue
        when, found, tag, date = max(earlier, key=lambda e: (e[0], e[1]))
        bare = lambda t: t.removeprefix("W/")
        if etag is not None and tag is not None:
            status = "resolved" if bare(etag) == bare(tag) else "changed"
        elif modified is not None and date is not None:
            status = "resolved" if modified == date else "changed"
        else:
            status = "unchecked"
        out.append((rid, found, status))
    return sorted(out, key=repr)


def test_revisits_against_plain_search(spark):
    rng = random.Random(5)
    made = []
    for rid in range(400):
        hot = rng.random() < 0.5
        made.append(
            (rid, "h.org/a" if hot else rng.choice(["h.org/b", "g.org", None]), rng.choice(["response", "revisit"]),
             rng.choice([None, *range(60)]), rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "d1", "d2"]),
             rng.choice([None, {"date": str(rid), "content-length": "9"}, {"date": "z", "x": str(rid)}]), rng.choice([None, "", f"body {rid}"]))
        )
    df = spark.createDataFrame(made, RECORD).withColumn("status", F.lit("clash")).withColumn("found", F.lit(1))
    got = warc.resolve_revisits(df)
    assert rows_of(got, "record_id", "response_id", "status") == plain_revisits(made)
    by_id = {r[0]: r for r in made}
    for row in got.filter("status = 'resolved'").collect():
        stored, sent = by_id[row["response_id"]], by_id[row["record_id"]]
        headers = dict(stored[6] or {}) | {k: v for k, v in (sent[6] or {}).items() if k != "content-length"}
        assert row["headers"] == headers and row["payload"] == stored[7]
    assert got.filter("status <> 'resolved' and headers is not null").isEmpty()
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_canonical_urls(spark):
    pairs = [
        ("HTTP://www.Example.org:80/A/?b=2&a=1&utm_source=x#f", "example.org/A?a=1&b=2"),
        ("https://example.org", "example.org"), ("https://example.org/?ref=1", "example.org"), ("", ""), (None, None), ("x", "x"),
        ("https://h.com:443/a", "h.com/a"), ("http://h.com:443/a", "h.com:443/a"), ("https://h.com:80/a", "h.com:80/a"), ("h.com:80", "h.com"),
        ("ftp://h.com:80/a", "h.com:80/a"),
    ]
    df = spark.createDataFrame(pairs, "url string, key string")
    assert df.filter(~warc.canonical_url(F.col("url")).eqNullSafe(F.col("key"))).count() == 0


def test_revisits_of_repeated_and_unknown_rows(spark):
    full = lambda rid, at, tag, body: (rid, "h.org/a", "response", at, tag, None, {"x": body}, body)
    again = lambda rid, at, tag, date: (rid, "h.org/a", "revisit", at, tag, None, {"date": date}, None)
    made = [
        full(1, 5, "a", "old"), full(1, 5, "b", "new"), full(1, 5, "b", "new"), full(None, 6, "c", "nameless"), full(9, None, "c", "timeless"),
        again(2, 7, "b", "one"), again(2, 7, "b", "two"), again(None, 8, "b", "three"), again(None, None, "b", "four"), again(3, 7, "a", "five"),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(made, RECORD))
    rows = [(r["record_id"], r["status"], r["payload"], sorted((r["headers"] or {}).items())) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted([
        (2, "resolved", "new", [("date", "one"), ("x", "new")]), (2, "resolved", "new", [("date", "two"), ("x", "new")]),
        (None, "resolved", "new", [("date", "three"), ("x", "new")]), (None, "unmatched", None, []), (3, "changed", None, []),
    ], key=repr)


def test_captures_of_odd_pages_equal_sql(spark, sf):
    from checks.compare import difference
    from graphsets.llm import queries as llm

    pages = [
        (1, "https://h.org:443/a", "x"), (1, "https://h.org:443/a", "x"), (1, "https://h.org/a", "y"), (None, "https://h.org/a", "x"),
        (None, "https://h.org/a", "x"), (3, None, "z"), (4, "http://www.h.org:443/b/?ref=1", None), (5, "", ""), (10, "http://h.org:443", "q"), (20, "http://h.org:443/", "q"),
    ]
    path = sf(pages=spark.createDataFrame(pages, "page_id long, url string, html string"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/pages.parquet/*.parquet'")
    name = "op1_revisit_resolution"
    assert difference(llm.queries()[name](spark, path), con, llm.oracle_sql()[name]) is None


# Token records

def test_records_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(records.session_tokenizer())
    df = docs(ODD).repartition(3)
    manifest = records.write_records(df, records.session_tokenizer(), str(tmp_path / "out"))
    got = records.read_records(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([d for d, _ in ODD], key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    expected = Counter((d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in ODD)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == expected
    files = [r.asDict() for r in manifest.orderBy("part").collect()]
    ids = records.fetch_records(files, [(len(files) - 1, files[-1]["n_docs"] - 1), (0, 0)])
    assert ids[0].tobytes() == bytes(got[-1]["ids"]) and ids[1].tobytes() == bytes(got[0]["ids"])
    assert sum(f["n_tokens"] for f in files) == sum(r["n_tokens"] for r in got)
    assert records.read_records(records.write_records(df.limit(0), records.session_tokenizer())).count() == 0


# Mixing

def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        left = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mix(spark, docs):
    rng = random.Random(2)
    made = [(n, " ".join(["w"] * rng.choice([0, 1, 5, 30])), None, rng.choice(["a", "a", "a", "a", "b", "é", "zz", None])) for n in range(900)]
    made += [(900, LONG, None, "b"), (901, None, None, "only null"), (5, "x y", None, "a"), (5, "x y", None, "a"), (None, "z", None, None)]
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(500)] + [(1, 0, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs(made)
    got = mixing.mix_documents(df, labels)
    out = got.collect()
    assert len(out) == len(made)
    sizes, taken, most = Counter(), Counter(), defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    targets = filled(sizes)
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, targets[r["source"]])
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= most[source] / 2 + 1e-6, source
    for r in out:
        assert r["copies"] in (r["epochs"], r["epochs"] + 1) and r["epochs"] == (targets[r["source"]] // sizes[r["source"]] if sizes[r["source"]] else 0)
    again = mixing.mix_documents(df.repartition(5), labels)
    assert rows_of(got, "doc_id", "size", "taken") == rows_of(again, "doc_id", "size", "taken")
    assert mixing.mix_documents(df.limit(0), labels).count() == 0
    assert mixing.mix_documents(docs([(1, None), (2, "")]), labels.limit(0)).agg(F.sum("taken")).first()[0] == 0


def test_better_documents_are_taken_more_often(spark, docs):
    df = docs([(n, "w " * 10, None, f"s{n % 3}") for n in range(3000)])
    labels = spark.createDataFrame([(n, n // 3 % 2, 0) for n in range(3000)], "doc_id long, quality int, toxic int")
    got = mixing.mix_documents(df, labels).filter("source = 's2'").toPandas()
    good = (got["doc_id"] // 3) % 2 == 1
    assert got["taken"][good].sum() > 1.5 * got["taken"][~good].sum() > 0


# Search

def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(maxscore, "SEEDS", 8)
    rng = random.Random(7)
    made = [(n, [round(rng.gauss(0, 0.3), 2) for _ in range(6)]) for n in range(500)]
    made[10] = (10, made[11][1])
    made[50] = (50, [0.0] * 6)
    made += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0]), (1050, [2.0]), (1051, []), (7, made[7][1])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("vector", F.lit(2))
    vectors = maxscore.integer_vectors(df)
    whole = []
    for n, v in made:
        if n is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((n, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    want = Counter()
    for at, (query, of_query) in enumerate(whole):
        if query % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(of_query, v)), n) for i, (n, v) in enumerate(whole) if i != at)
            want.update((query, r + 1, n, -s) for r, (s, n) in enumerate(scores[:5]))
    assert Counter(map(tuple, maxscore.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect())) == want
    few = maxscore.integer_vectors(df.filter("vec_id in (0, 1, 2)"))
    assert maxscore.top_k(few, few.filter("vec_id = 0")).count() == 2
    assert maxscore.top_k(few.limit(0), few).count() == 0 and maxscore.top_k(few, few.limit(0)).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, [0.5]), (1, [0.9]), (1, [0.9]), (50, [1.0]), (50, [0.7])], "vec_id long, embedding array<double>")
    vectors = maxscore.integer_vectors(df)
    got = sorted(map(tuple, maxscore.top_k(vectors, vectors.filter("vec_id = 50"), 3).collect()))
    assert got == sorted([
        (50, 1, 1, 230 * 256), (50, 2, 1, 230 * 256), (50, 3, 50, 179 * 256),
        (50, 1, 50, 256 * 179), (50, 2, 1, 230 * 179), (50, 3, 1, 230 * 179),
    ])


def test_level_rises_and_skips_vectors():
    rng = np.random.default_rng(3)
    n, width = 2000, 24
    vectors = rng.integers(-20, 20, (n, width))
    vectors[:, :3] *= 60
    shard = maxscore.Shard(np.arange(n), np.arange(n), vectors)
    for own in range(0, 40, 4):
        scores = vectors @ vectors[own]
        order = [i for i in np.lexsort((np.arange(n), -scores)).tolist() if i != own][:5]
        ids, got, probed = shard.search(own, vectors[own], 5)
        assert ids.tolist() == order and got.tolist() == scores[order].tolist() and probed < n // 4
        assert shard.search(own, vectors[own], 5, int(scores[order[-1]]))[2] <= probed
        assert shard.search(own, vectors[own], 5, int(scores[order[0]]) + 1)[2] == 0


# Lines

def plain_dedup(made, min_docs, min_chars, keep_first):
    unique = sorted(made, key=lambda r: r[0] if r[0] is not None else -1)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    places = defaultdict(list)
    for doc, (_, text) in enumerate(unique):
        for pos, line in enumerate((text or "").split("\n")):
            if len(key(line)) >= min_chars:
                places[key(line)].append((doc, pos))
    drop = set()
    for found in places.values():
        if len({d for d, _ in found}) >= min_docs:
            drop.update(found[1:] if keep_first else found)
    return Counter(
        (i, len((t or "").split("\n")), "\n".join(x for p, x in enumerate((t or "").split("\n")) if (d, p) not in drop))
        for d, (i, t) in enumerate(unique)
    )


@pytest.mark.parametrize("min_docs, min_chars, keep_first", [(10, 1, False), (2, 3, False), (3, 0, False), (2, 1, True), (5, 1, True)])
@pytest.mark.parametrize("parts", [1, 40])
def test_lines_against_plain_counting(spark, docs, min_docs, min_chars, keep_first, parts):
    rng = random.Random(min_docs)
    common = ["Hot line", " hot LINE\t", "b", "Ärger", "", "  ", "c c", "rare %d"]
    made = [(n, "\n".join((rng.choice(common[:2] * 3 + common)).replace("%d", str(n % 9)) for _ in range(rng.randrange(1, 12)))) for n in range(120)]
    made += [(200, None), (201, ""), (202, "\n\n"), (203, LONG), (203, LONG), (None, "hot line\nb"), (204, "Hot line\n" * 3000)]
    made += [(None, "only without\na name")] * 12 + [(205, "only of one\nname")] * 12
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = lines.numbered(docs(made))
        maps = lines.keep_bitmaps(df, min_docs, min_chars, keep_first)
        got = lines.apply_bitmaps(df, maps).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter((r["doc_id"], r["n_lines"], r["text"]) for r in got) == plain_dedup(made, min_docs, min_chars, keep_first)


def test_line_stream_holds_few_lines():
    state = lines._Stream(min_docs=3, keep_first=False)
    n = 5000
    state.add([np.array([0], np.int64)] * 5)
    for k in range(n):
        state.add([np.array([x], np.int64) for x in (7, 7, k, k, 0)])
        assert len(state.held) < 3
        list(state.take())
    state.end()
    assert state.open[-1][4].tolist() == [-1]


def test_no_lines(spark, docs):
    df = lines.numbered(docs([(1, "a")]).limit(0))
    assert lines.apply_bitmaps(df, lines.keep_bitmaps(df)).count() == 0


# Shards

def test_byte_shards(spark, docs):
    rng = random.Random(4)
    made = ODD + [(n, "é" * rng.randrange(400)) for n in range(10, 700)] + [(7, "same " * 20)] * 30
    got = shards.document_shards(docs(made).repartition(7), 13).orderBy("shard", "slot").collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in made
    )
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    start, total = 0, sum(r["size"] for r in got)
    slots = Counter()
    for r in got:
        assert r["start"] == start and r["slot"] == slots[r["shard"]]
        assert r["shard"] == (2 * start + r["size"]) * 13 // (2 * total)
        start += r["size"]
        slots[r["shard"]] += 1
    assert shards.document_shards(docs(made).limit(0), 4).count() == 0


# Language

def sentences(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_language_id(spark, docs):
    rng = random.Random(6)
    letters = {"aa": "abcdeé", "bb": "cdefgh", "cc": "éhijkl"}
    made = [(n, sentences(rng, letters[lang := rng.choice(sorted(letters))], rng.randrange(5, 60)), lang) for n in range(200)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 %% \n", "aa"), (903, "日本語 " * 30, None), (904, sentences(rng, letters["bb"], 20_000), "bb"), (None, sentences(rng, letters["cc"], 30), None)]
    got = {}
    for r in langid.identify(docs(made + odd + made[:1])).collect():
        got[r["doc_id"]] = r
        assert 0 <= r["score"] <= 1 and r["class"] == "clash"
    held = [n for n, _, _ in made if zlib.crc32(str(n).encode()) % 4 == 2]
    truth = {n: lang for n, _, lang in made}
    assert sum(got[n]["lang_pred"] == truth[n] for n in held) >= 0.95 * len(held) > 20
    assert [got[n]["lang_pred"] for n in (900, 901, 902)] == ["und"] * 3 and all(got[n]["rejected"] for n in (900, 901, 902, 903))
    assert got[904]["lang_pred"] == "bb" and got[None]["lang_pred"] == "cc" and not got[None]["rejected"]
    assert langid.identify(docs(made).limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs([(1, "text", None)])).collect()} == {"und"}


def test_a_language_of_one_word_wins_nothing(spark, docs):
    rng = random.Random(7)
    letters = {"aa": "abcdeé", "bb": "cdefgh"}
    learn = [n for n in range(400) if zlib.crc32(str(n).encode()) % 4 != 2]
    made = [(n, sentences(rng, letters[lang := rng.choice(sorted(letters))], 60), lang) for n in learn[1:]]
    got = langid.identify(docs([(learn[0], "ok", "zz"), *made])).collect()
    wrong = [r["doc_id"] for r in got if r["lang_pred"] != r["lang"] or r["rejected"]]
    assert len(got) == len(made) + 1 and not wrong


def test_held_out_documents_teach_nothing(spark, docs):
    held = [n for n in range(400) if zlib.crc32(str(n).encode()) % 4 == 2][:40]
    rest = [n for n in range(400) if zlib.crc32(str(n).encode()) % 4 != 2][:40]
    df = docs([(n, "lorem ipsum dolor", "held") for n in held] + [(n, "lorem ipsum dolor", "kept") for n in rest])
    assert {r[0] for r in langid.identify(df).select("lang_pred").collect()} == {"kept"}
    assert set(langid.samples(df)) == {"kept"} and langid.samples(df)["kept"] == ["lorem ipsum dolor"]


# Benchmark leaks

def test_leaks(spark, docs, monkeypatch):
    items = [
        (1, "A farmer sold 12 apples to Anna for 3 dollars each and kept 5 apples for her sister"),
        (2, "the quick red fox jumps over the lazy dog while seven old men look on from the hill"),
        (3, None), (4, ""), (5, "of the and"), (2, "the quick red fox jumps over the lazy dog while seven old men look on from the hill"), (None, "nobody knows how many items have no number in this small table"),
    ]
    base = " filler words that stand around without a meaning "
    made = [
        (1, base + items[0][1].upper() + base), (2, base * 400 + items[1][1] + base), (3, None), (4, ""), (5, base),
        (6, "A farmer sold 99 apples to Zoe for 4 euros each and kept 8 apples for her sister"), (6, "A farmer sold 99 apples to Zoe for 4 euros each and kept 8 apples for her sister"),
        (None, items[6][1]), (7, "of the and"), (8, "of the and more"), (9, " ".join(items[1][1].split()[:9])), (10, LONG),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1))
    expected = sorted([(1, 1), (2, 2), (2, 2), (6, 1), (6, 1), (None, None), (7, 5)], key=repr)
    assert rows_of(decontam.find_leaks(docs(made), benchmark), "doc_id", "item_id") == expected
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 20)  # several blocks
    assert rows_of(decontam.find_leaks(docs(made), benchmark), "doc_id", "item_id") == expected
    left = decontam.remove_leaks(docs(made), benchmark)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 8, 9, 10] and left.columns == docs(made).columns
    assert decontam.find_leaks(docs(made), benchmark.limit(0)).count() == 0
    assert decontam.find_leaks(docs(made).limit(0), benchmark).count() == 0


def plain_words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_leaks_against_all_pairs(spark, docs):
    """Items and documents without names and numbers: what agrees at one shift is found, and nothing whose words in order are too few."""
    rng = random.Random(11)
    stock = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    text = lambda n: [rng.choice(stock) for _ in range(n)]
    items = [(n, " ".join(text(rng.choice([5, 6, 9, 14, 23, 40])))) for n in range(30)] + [(30, "字" * 4 + "书里有山水和花"), (31, None)]
    made = [(1000, None), (1001, ""), (1002, "前文字" + "字" * 4 + "书里有山水和花后文")]
    for n in range(250):
        item = plain_words(rng.choice(items[:30])[1])
        for _ in range(rng.randrange(len(item) // 3 + 1)):
            item[rng.randrange(len(item))] = rng.choice(stock)
        if rng.random() < 0.3:
            del item[rng.randrange(len(item))]
        made.append((n, " ".join(text(rng.randrange(60)) + item + text(rng.randrange(60)))))
    found = {tuple(r) for r in decontam.find_leaks(docs(made), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()}
    assert (1002, 30) in found and not {d for d, _ in found} & {1000, 1001}
    surely, hardly = set(), set()
    for doc, whole in made[3:]:
        theirs = plain_words(whole)
        for item, asked in items[:30]:
            ours = plain_words(asked)
            least = 0.8 * len(ours) - 1e-9
            at_one_shift = max(
                sum(0 <= k + shift < len(theirs) and theirs[k + shift] == w for k, w in enumerate(ours))
                for shift in range(-len(ours), len(theirs))
            )
            if at_one_shift >= least:
                surely.add((doc, item))
            held = sum((Counter(ours) & Counter(theirs)).values())
            if held >= least:
                hardly.add((doc, item))
    assert len(surely) > 100 and surely <= found <= hardly | {(1002, 30)}


def test_blocks_of_the_benchmark_are_bounded(spark):
    texts = [("two words", 2), ("12 apples, 3.5", 4), ("字字 a", 3), ("", 0), ("...", 0)]
    df = spark.createDataFrame(texts, "text string, n long")
    assert df.filter(decontam._word_count(F.col("text")) != F.col("n")).count() == 0


# Similarity join

def plain_join(made, threshold=0.8):
    sets = []
    for _, text in made:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None)
    classes = sorted({s for s in sets if s}, key=repr)
    number = {s: n for n, s in enumerate(classes)}
    copies = Counter(number[s] for s in sets if s)
    links, docs_, root = Counter(), Counter(), list(range(len(classes)))
    for a in range(len(classes)):
        for b in range(a):
            common = len(classes[a] & classes[b])
            if common and common / (len(classes[a]) + len(classes[b]) - common) >= threshold:
                for x, y in ((a, b), (b, a)):
                    links[x] += 1
                    docs_[x] += copies[y]
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    names = lambda pick: min((d for (d, _), s in zip(made, sets) if s and pick(number[s]) and d is not None), default=None)
    out = []
    for (doc, _), s in zip(made, sets):
        if not s:
            out.append((doc, doc, doc, Counter((d, t) for d, t in made)[(doc, _)], 0, 0))
        else:
            n = number[s]
            out.append((doc, names(lambda m: m == n), names(lambda m: root[m] == root[n]), copies[n], links[n], docs_[n]))
    return sorted(out, key=repr)


def test_join_against_all_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # several blocks for each bucket
    rng = random.Random(9)
    vocabulary = [f"w{n}" for n in range(300)]
    made = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            made.append((len(made), " ".join(words)))
    base = [rng.choice(vocabulary) for _ in range(150)]
    for n in range(60):  # one large group of different texts
        words = list(base)
        words[rng.randrange(150)] = f"u{n}"
        made.append((len(made), " ".join(words)))
    made += [(500 + n, "An exact copy, of one text here.") for n in range(40)] + [(600, "an exact COPY of one text here")]
    made += [(700, None), (701, ""), (702, "%%"), (703, LONG), (704, LONG + "more"), (705, "one"), (706, "One!"), (707, "x y z a"), (None, made[0][1])]
    got = jaccard.near_duplicates(docs(made).repartition(5))
    assert rows_of(got, "doc_id", "class_id", "group_id", "copies", "links", "linked_docs") == plain_join(made)
    firsts = got.filter("is_first").collect()
    assert len(firsts) == len({r[2] for r in plain_join(made)})
    assert jaccard.near_duplicates(docs(made).limit(0)).count() == 0


def test_rows_alike_and_unknown_ids(spark, docs):
    made = [(None, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (None, None), (3, ""), (3, "")]
    got = rows_of(jaccard.near_duplicates(docs(made)), "doc_id", "class_id", "copies", "links", "is_first")
    assert got == sorted([(None, None, 2, 0, True)] * 2 + [(None, None, 1, 0, True)] * 2 + [(3, 3, 1, 0, True)] * 2, key=repr)


def test_few_rows_pass_to_python_at_a_time(spark, docs, monkeypatch):
    seen, plain = [], jaccard.saved
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(jaccard, "saved", lambda df, *more: (seen.append(more), plain(df, *more))[1])
    before = spark.conf.get(name)
    jaccard.near_duplicates(docs([(1, "a b c d e f g"), (2, "a b c d e f g h")]))
    assert {step[0] for step in seen if step[1:] == (jaccard.BATCH_ROWS,)} == {"signatures", "units", "shingles", "checked"}
    sizes = spark.range(0, 100, 1, 1).mapInArrow(lambda batches: (b for b in batches if not b.num_rows > 7), "id long")
    assert plain(sizes, "few", 7).count() == 100 and plain(sizes, "all").count() == 0
    assert spark.conf.get(name) == before


# Toxicity

def test_toxicity(spark, docs):
    rng = random.Random(8)
    plain = [sentences(rng, "aeioulnrst", 1) for _ in range(300)]
    text = lambda: [rng.choice(plain) for _ in range(rng.randrange(10, 60))]
    made, labels = [], []
    for n in range(600):
        words, toxic = text(), n % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "clown", "scumbag"]))
        made.append((n, " ".join(words)))
        labels.append((n, 1, int(toxic)))
    disguised = [(1000 + k, " ".join([*text(), w, *text()])) for k, w in enumerate(["m0ron", "cl0wn", "s.c.u.m.b.a.g", "m o r o n", "clowwwwn", "MORON!!"])]
    odd = [(2000, None), (2001, ""), (2002, "%%% 12"), (2003, LONG), (None, "clown"), (2004, " ".join(text())), (2004, " ".join(text()))]
    table = spark.createDataFrame(labels + [(1, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs(made + disguised + odd), table).collect()
    assert len(got) == len(made + disguised + odd)
    truth = {n: t for n, _, t in labels}
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r["predicted"])
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["class"] == "clash"
    assert sum(by_id[n] != [t] for n, t in truth.items()) <= 5
    assert sum(by_id[1000 + k] == [1] for k in range(len(disguised))) >= 5
    assert all(by_id[n][0] == 0 for n in (2000, 2001, 2002, 2003, 2004)) and by_id[None] == [1]
    assert toxicity.score_toxicity(docs(made).limit(0), table).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(docs(made[:9]), table.limit(0)).collect()} == {0}


def test_copies_of_one_toxic_text_mark_no_words(spark, docs):
    rng = random.Random(1)
    once = sentences(rng, "bcdfg", 30)
    made = [(n, once) for n in range(200)] + [(n, sentences(rng, "aeiou", 20)) for n in range(200, 900)]
    labels = spark.createDataFrame([(n, 1, int(n < 200)) for n in range(900)], "doc_id long, quality int, toxic int")
    word = next(w for w in once.split() if len(w) > 3)
    got = toxicity.score_toxicity(docs([*made, (5000, f"aeio {word} uoie")]), labels).filter("doc_id = 5000").first()
    assert got["predicted"] == 0


def test_words_of_stock_phrases_count_at_any_size(spark, docs):
    rng = random.Random(3)
    plain = [sentences(rng, "aeioulnrst", 1) for _ in range(300)]
    before = ["such", "you", "real", "total", "poor", "big", "old"]
    made, labels = [], []
    for n in range(4000):
        words, toxic = [rng.choice(plain) for _ in range(12)], n % 2
        made.append((n, " ".join([*words, rng.choice(before), "clown" if toxic and n % 3 == 0 else rng.choice(plain), *words[:2]])))
        labels.append((n, 1, toxic))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts = [(9000, f"{' '.join(plain[:9])} awful clown"), (9001, f"{' '.join(plain[:9])} awful")]
    got = toxicity.score_toxicity(docs(made + texts), table).filter("doc_id >= 9000").collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {9000: 1, 9001: 0}


def test_sha_of_kept_lines(spark, docs):
    df = lines.numbered(docs([(1, "a\nb"), (2, None)]))
    got = lines.apply_bitmaps(df, lines.keep_bitmaps(df, 2, 1, False)).select("doc_id", F.sha2("text", 256)).collect()
    assert dict(map(tuple, got)) == {1: hashlib.sha256(b"a\nb").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_what_clean_texts_write_is_no_disguise(spark, docs):
    """A word that differs from a toxic one by a double letter, or two words in a row, where clean texts hold them."""
    rng = random.Random(6)
    plain = [sentences(rng, "aeiulnrt", 1) for _ in range(200)]
    text = lambda: [rng.choice(plain) for _ in range(20)]
    made, labels = [], []
    for n in range(900):
        toxic, words = n % 3 == 0, text()
        words[5:5] = ["loser" if toxic else "looser"] if n % 2 else (["scumbag"] if toxic else ["scum", "bag"])
        made.append((n, " ".join(words)))
        labels.append((n, 1, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tested = {"a looser knot": 0, "the scum bag here": 0, "a lloser here": 1, "a los er here": 1, "a loser knot": 1, "a l0ser knot": 1}
    texts = [(9000 + i, " ".join([*text()[:4], t, *text()[:4]])) for i, t in enumerate(tested)]
    got = toxicity.score_toxicity(docs(made + texts), table).filter("doc_id >= 9000").collect()
    assert {r["doc_id"] - 9000: r["predicted"] for r in got} == dict(enumerate(tested.values()))


def test_classes_around_a_hub(spark, monkeypatch):
    from graphsets.operators import pairing

    monkeypatch.setattr(pairing, "HUB_ROWS", 10)
    links = [("h", f"x{i:03d}") for i in range(120)] + [(f"a{i:02d}", "h") for i in range(40)] + [("y", "z"), ("z", "y"), ("z", "zz")]
    edges = spark.createDataFrame([(bytes(a, "ascii"), bytes(b, "ascii")) for a, b in links], "class binary, joined binary")
    names = sorted({x for pair in links for x in pair} | {"alone"})
    classes = spark.createDataFrame([(bytes(x, "ascii"),) for x in names], "class binary")
    got = {bytes(r["class"]).decode(): bytes(r["root"]).decode() for r in jaccard._components(classes, edges).collect()}
    assert got == {x: "y" if x[0] in "yz" else x if x == "alone" else "a00" for x in names}
