"""Phrase collocations by best-first growth of a frontier of prefixes.

A phrase of 2 to 4 words scores its count against the counts of its two parts at the
worst cut. What grows from a prefix p holds p's first words as first parts and occurs no
more often than p, so f(p) against the counts of p's own prefixes bounds every score below
p. The frontier holds counted phrases; those whose score or bound reaches a language's
level are grown by one word at either end, counted over all documents. The level falls
until as many survivors as asked for reach it, so that every phrase and tie above is known.

Words are 64-bit hashes of language and word while they are counted, and phrases tuples of
them. Sets that tasks need travel as bitmaps of fixed size; a false hit only counts a
phrase that nobody asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.llm.codes import mix, run_hashes
from graphsets.llm.store import saved

BITS = 26  # of a bitmap, 8 MB
BLOCK_CHARS = 2_000_000
LONGEST = 4
STEP = 1000  # width of a score bucket
WIDER = 4
SALTS = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_KIND = np.zeros(256, np.uint8)  # of a word, between words, between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2


class Words:
    """The words of some texts: hashes, where pieces end, and numbers of equal words."""

    def __init__(self, texts: list[str], langs: list[str], seed: int):
        self.raw = LOWER[np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)]
        kind = _KIND[self.raw]
        at = np.flatnonzero(kind == 0)
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > 1
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        self.begin, self.end = at[first], at[first] + sizes
        ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
        self.doc = np.searchsorted(ends, self.begin, "right")
        lang = np.array([_seeded(x, seed) for x in langs], np.uint64)
        hashes = mix(run_hashes(self.raw[at], first, sizes) ^ lang[self.doc])
        self.hashes, self.index, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        breaks = np.cumsum(kind == 2)[self.begin] if len(self.begin) else self.begin
        self.joined = breaks[1:] == breaks[:-1]  # word i and the next one stand in one piece

    def counts(self) -> np.ndarray:
        return np.bincount(self.number, minlength=len(self.hashes))

    def strings(self) -> list[bytes]:
        raw = self.raw.tobytes()
        return [raw[a:b] for a, b in zip(self.begin[self.index].tolist(), self.end[self.index].tolist(), strict=True)]


def _seeded(lang: str, seed: int) -> int:
    raw = lang.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw, seed) << 32 | zlib.crc32(raw + b"\x00", seed ^ 0x5BD1E995)


def _blocks(rows: pa.RecordBatch, seed: int) -> Iterator[tuple[Words, list[str]]]:
    texts, langs, size = [], [], 0
    for text, lang in zip(rows["text"], rows["lang"], strict=True):
        texts.append(text.as_py() or "")
        langs.append("und" if (found := lang.as_py()) is None else found)
        size += len(texts[-1])
        if size >= BLOCK_CHARS:
            yield Words(texts, langs, seed), langs
            texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs, seed), langs


def _place(*hashes):
    """Where a tuple of hashes lies in a bitmap, for columns and for arrays alike."""
    of = len(hashes) - 1
    if isinstance(hashes[0], Column):
        parts = [F.shiftright(h, 21 * (of - i)) for i, h in enumerate(hashes)]
        return reduce(lambda a, b: a.bitwiseXOR(b), parts).bitwiseAND(F.lit((1 << BITS) - 1))
    parts = [h >> np.int64(21 * (of - i)) for i, h in enumerate(hashes)]
    return reduce(np.bitwise_xor, parts) & np.int64((1 << BITS) - 1)


def _keys(size: int) -> list[str]:
    return [f"h{i}" for i in range(1, size + 1)]


def bitmap(phrases: DataFrame, size: int) -> np.ndarray:
    """A bit for each place that a phrase of ``phrases`` has; 2 ** BITS / 64 rows reach the driver at most."""
    place = _place(*[F.col(h) for h in _keys(size)])
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    rows = (
        phrases.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word"))
        .agg(F.bit_or(bit).alias("bits")).toPandas()
    )
    out = np.zeros((1 << BITS) // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def word_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, word, h1, a) of every word. Two words of one hash are an error; another seed parts them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for words, langs in _blocks(rows, seed):
                owner = words.doc[words.index].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[i] for i in owner], pa.string()), pa.array(words.strings(), pa.binary()).cast(pa.string()),
                        pa.array(words.hashes.view(np.int64)), pa.array(words.counts().astype(np.int64)),
                    ],
                    ["lang", "word", "h1", "n"],
                )

    rows = docs.select("text", "lang").mapInArrow(count, "lang string, word string, h1 long, n long")
    words = saved(rows.groupBy("lang", "word", "h1").agg(F.sum("n").alias("a")), "words")
    if not words.groupBy("h1").count().filter("count > 1").isEmpty():
        raise ValueError(f"two words have one hash with seed {seed}; take another")
    return words


def _grams(words: Words, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first words, their hashes and those after) of the runs of ``size`` words within pieces."""
    n = len(words.number) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), [np.zeros(0, np.int64)] * size
    inside = np.ones(n, bool)
    for step in range(size - 1):
        inside &= words.joined[step : step + n]
    first = np.flatnonzero(inside)
    hashes = words.hashes.view(np.int64)
    return first, [hashes[words.number[first + i]] for i in range(size)]


def phrase_counts(docs: DataFrame, size: int, at_ends: np.ndarray | None, within: np.ndarray, whole: np.ndarray | None, min_count: int, seed: int) -> DataFrame:
    """(h1.., a): exact counts of phrases of ``size`` words that occur ``min_count`` times.

    Only phrases are counted whose single words (for pairs) or whose pairs are in the
    bitmap ``within``, and that begin or end with a phrase of ``at_ends`` (one word less) or
    are in ``whole``, where these are given.
    """
    spark, keys = docs.sparkSession, _keys(size)
    sent = spark.sparkContext.broadcast((at_ends, within, whole))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, inner, exact = sent.value
        of = 1 if size == 2 else 2
        for rows in batches:
            for words, _ in _blocks(rows, seed):
                first, hashes = _grams(words, size)
                keep = np.ones(len(first), bool)
                if ends is not None:
                    keep &= _has(ends, _place(*hashes[:-1])) | _has(ends, _place(*hashes[1:]))
                if exact is not None:
                    keep &= _has(exact, _place(*hashes))
                first, hashes = first[keep], [h[keep] for h in hashes]
                keep = np.ones(len(first), bool)
                for start in range(size - of + 1):
                    keep &= _has(inner, _place(*hashes[start : start + of]))
                first, hashes = first[keep], [h[keep] for h in hashes]
                # Numbers of equal runs, grown word by word; they fit in 32 bits.
                number = words.number[first].astype(np.int64)
                for step in range(1, size):
                    found, index, number = np.unique(
                        number << 32 | words.number[first + step], return_index=True, return_inverse=True
                    )
                if len(first):
                    total = np.bincount(number, minlength=len(found))
                    yield pa.RecordBatch.from_pydict({k: h[index] for k, h in zip(keys, hashes, strict=True)} | {"n": total})

    kind = ", ".join(f"{k} long" for k in keys)
    rows = docs.select("text", "lang").mapInArrow(count, f"{kind}, n long")
    return rows.groupBy(*keys).agg(F.sum("n").alias("a")).filter(F.col("a") >= min_count)


def _ratio(count: Column, below: Column) -> Column:
    """floor(2000000 * count / below), exact."""
    wide = F.lit(2_000_000).cast("decimal(38,0)")
    return F.call_function("div", (count.cast("decimal(20,0)") * wide).cast("decimal(38,0)"), below.cast("decimal(38,0)")).cast("long")


def _lookup(phrases: DataFrame, known: DataFrame, size: int, start: int, name: str, how: str = "inner") -> DataFrame:
    """Adds the count of the ``size`` words from ``start`` on as ``name``."""
    keys = _keys(size)
    renamed = known.select(*[F.col(k).alias(f"h{i + start}") for i, k in enumerate(keys, 1)], F.col("a").alias(name))
    return phrases.join(renamed, [f"h{i + start}" for i in range(1, size + 1)], how)


def scored(phrases: DataFrame, counts: dict[int, DataFrame], size: int) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut (the first, if several), and ``bound`` of what grows from it.

    Parts that are not counted yet give nulls in ``open``: true then, and the score is an upper bound.
    """
    out = phrases
    for cut in range(1, size):
        out = _lookup(out, counts[cut], cut, 0, f"l{cut}")
        out = _lookup(out, counts[size - cut], size - cut, cut, f"r{cut}", "left")
    cuts = [
        F.when(F.col(f"r{cut}").isNotNull(), F.struct(
            _ratio(F.col("a"), F.col(f"l{cut}") + F.col(f"r{cut}")).alias("score"), F.lit(cut).alias("k"),
            F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r"),
        ))
        for cut in range(1, size)
    ]
    lowest = F.array_min(F.array_compact(F.array(*cuts)))
    bound = reduce(F.least, [_ratio(F.col("a"), F.col(f"l{cut}") + F.col("a")) for cut in range(1, size)]) if size > 2 else _ratio(F.col("a"), F.col("l1") + F.col("a"))
    missing = reduce(Column.__or__, [F.col(f"r{cut}").isNull() for cut in range(1, size)])
    return out.select(*_keys(size), "a", lowest.alias("_cut"), bound.alias("bound"), missing.alias("open")).select(
        *_keys(size), "a", "_cut.l", "_cut.r", F.coalesce("_cut.score", F.lit(1_000_000)).alias("score"), "bound", "open"
    )


def _levels(candidates: DataFrame, most: int) -> DataFrame:
    """(lang, level): the bucket of scores in which the ``most``-th best candidate lies; 0 if there are fewer."""
    buckets = candidates.groupBy("lang", F.expr(f"score div {STEP}").alias("bucket")).count()
    above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("bucket")))
    return buckets.withColumn("above", above).groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("above") >= most, F.col("bucket") * STEP)), F.lit(0)).alias("level")
    )


def _extended(phrases: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """Adds ``longest``: the highest count of a phrase of one word more that begins or ends with the phrase."""
    keys = _keys(size)
    heads = longer.select(*keys, "a")
    tails = longer.select(*[F.col(f"h{i + 1}").alias(f"h{i}") for i in range(1, size + 1)], "a")
    most = heads.unionByName(tails).groupBy(*keys).agg(F.max("a").alias("longest"))
    return phrases.join(most, keys, "left")


def collocations(docs: DataFrame, top: int = 2000, min_count: int = 30, seed: int = 0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best collocations of each language.

    Candidates are phrases of 2 to 4 words with ``min_count`` occurrences; one that lies in a
    longer candidate with four fifths of its occurrences is dropped (it is enough to look at
    phrases of one word more, as these occur no less often). A null lang is ``und``; null and
    empty texts have no words; rows that are alike all count. Languages without candidates,
    and empty tables, give no rows.
    """
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    words = word_counts(docs, seed)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = saved(words.filter(F.col("a") >= min_count), "frequent_words")
    pairs = saved(phrase_counts(docs, 2, None, bitmap(frequent, 1), None, min_count, seed), "pairs")
    within = bitmap(pairs, 2)
    langs = frequent.select("h1", "lang")
    counts = {1: frequent, 2: pairs}
    of_pairs = saved(scored(pairs, counts, 2).join(langs, "h1"), "frontier")
    known: dict[int, DataFrame] = {2: of_pairs}
    found: dict[int, DataFrame | None] = {3: None, 4: None}
    suffixes: DataFrame | None = None
    most, levels = top, None

    def grown(size: int, active: DataFrame) -> DataFrame:
        """All phrases of ``size`` words known so far, with those that begin or end with an active one."""
        new = phrase_counts(docs, size, bitmap(active, size - 1), within, None, min_count, seed)
        old = found[size]
        both = new if old is None else old.unionByName(new).groupBy(*_keys(size)).agg(F.max("a").alias("a"))
        return saved(both, f"phrases_{size}")

    while True:
        most *= WIDER
        every = reduce(DataFrame.unionByName, [x.select("lang", "score") for x in known.values()])
        reached = _levels(every, most)
        if levels is not None:
            # Languages that are settled keep their level, so nothing new of them is active.
            reached = reached.join(levels, "lang").select(
                "lang", F.when(F.col("settled"), F.col("old")).otherwise(F.least("level", "old")).alias("level"), "old"
            )
        else:
            reached = reached.withColumn("old", F.lit(None).cast("long"))
        reached = saved(reached, "levels")
        best, reach = F.greatest("score", "bound"), F.col("level")
        # What reached the old level has been grown.
        fresh = (best >= reach) & (F.col("old").isNull() | (best < F.col("old")))
        for size in (3, 4):
            active = known[size - 1].join(reached, "lang").filter(fresh)
            found[size] = grown(size, active)
            counts[size] = found[size] if size == 4 or suffixes is None else found[size].unionByName(suffixes).dropDuplicates(_keys(size))
            known[size] = saved(scored(found[size], counts, size).join(langs, "h1"), "frontier")
        # A phrase of four words whose last three were never active needs their count.
        short = known[4].join(reached, "lang").filter(F.col("open") & (F.col("score") >= F.col("level")))
        if not short.isEmpty():
            tails = short.select(*[F.col(f"h{i + 1}").alias(f"h{i}") for i in range(1, 4)])
            more = phrase_counts(docs, 3, None, within, bitmap(tails, 3), min_count, seed)
            suffixes = saved(more if suffixes is None else suffixes.unionByName(more).dropDuplicates(_keys(3)), "suffixes")
            counts[3] = found[3].unionByName(suffixes).dropDuplicates(_keys(3))
            known[4] = saved(scored(found[4], counts, 4).join(langs, "h1"), "frontier")
        whole = []
        for size in (2, 3, 4):
            above = known[size].join(reached, "lang").filter(F.col("score") >= F.col("level"))
            if size < LONGEST:
                above = _extended(above, found[size + 1], size).filter(
                    F.col("longest").isNull() | (F.col("longest") * 5 < F.col("a") * 4)
                )
            none = [F.lit(None).cast("long").alias(h) for h in _keys(LONGEST)[size:]]
            whole.append(above.select("lang", *_keys(size), *none, "a", "l", "r", "score"))
        survivors = saved(reduce(DataFrame.unionByName, whole), "survivors")
        held = survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
        levels = saved(
            reached.drop("old").join(held, "lang", "left").select(
                "lang", F.col("level").alias("old"),
                ((F.coalesce("held", F.lit(0)) >= top) | (F.col("level") == 0)).alias("settled"),
            ),
            "settled",
        )
        if levels.filter("not settled").isEmpty():
            break
    named = survivors
    for i, key in enumerate(_keys(LONGEST)):
        names = frequent.select(F.col("h1").alias(key), F.col("word").alias(f"w{i}"))
        named = named.join(names, key, "left")
    phrase = F.concat_ws(" ", *[f"w{i}" for i in range(LONGEST)])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = named.withColumn("phrase", phrase).withColumn("_salt", F.pmod(F.xxhash64(*_keys(LONGEST)), F.lit(SALTS)))
    for group in (["lang", "_salt"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
