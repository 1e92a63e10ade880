"""Toxicity of texts whose words may be disguised.

A disguised word is a noisy reading of a plain one: letters written as digits or signs,
set apart by spaces or points, split, or repeated. Its readings form a character lattice, and the
Viterbi path under a character language model of the corpus is the restored word. Texts are
scored on plain and restored words, with log odds learned from labels.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphsets.llm.codes import DIGIT, LETTER, LIMIT, SPACE, blocks, flatten, mix, powers, run_hashes, run_sums, tables
from graphsets.llm.langid import held_out
from graphsets.llm.store import saved

SAMPLE_DOCS = 10_000  # labelled documents of each class that words are learned from; the bound of the fit
MIN_CONTEXTS = 5  # of a word in toxic texts, whatever their number
MIN_ODDS = 2.0  # at the lower end of the interval
MARGIN = 1.64  # standard errors
MOST_ODDS = 8.0
THRESHOLD = 0.3
SALTS = 64
SYMBOLS = 27  # blank and a to z
SPACED = 3  # single letters in a row that may be one word
PIECES, JOINED = 3, 16  # pieces that a split word may have, and the signs of all of them
WORDS_KEPT = 200_000
MARKS = [ord(c) for c in "!*(+¡"]  # at a word's end

# What a sign may stand for, and how likely each way of writing is.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "*": "aeiou",
}
AS_LETTER, LEFT_OUT, AS_BLANK, ONE_OF_RUN = log(0.5), log(0.1), log(0.05), log(0.5)
ONE_OF_TWO, BOTH_OF_TWO, SPLIT = log(0.2), log(0.8), log(0.05)
BETWEEN = log(0.45)


@cache
def folded() -> np.ndarray:
    """Symbol of each code point: 1 to 26 for Latin letters with or without marks, else 0."""
    out = np.zeros(LIMIT, np.uint8)
    kind, lower, _ = tables()
    for point in np.flatnonzero(kind == LETTER).tolist():
        if point < 0x2000 or 0xFF00 <= point < 0x10000:
            first = unicodedata.normalize("NFKD", chr(int(lower[point])))[0].lower()
            if "a" <= first <= "z":
                out[point] = ord(first) - 96
    return out


def gram_counts(texts: list[str]) -> np.ndarray:
    """How often each run of four symbols occurs; blanks stand for all signs between words."""
    points, offsets = flatten([f"  {t} " for t in texts])
    if not len(points):
        return np.zeros(SYMBOLS**4, np.int64)
    symbol = folded()[points].astype(np.int64)
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0)
    symbol = np.concatenate([[0, 0], symbol[keep]])
    code = ((symbol[:-3] * SYMBOLS + symbol[1:-2]) * SYMBOLS + symbol[2:-1]) * SYMBOLS + symbol[3:]
    return np.bincount(code, minlength=SYMBOLS**4)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after three others, each order smoothed by the next shorter one."""
    counts = counts.reshape((SYMBOLS,) * 4).astype(np.float64)
    shorter = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, 5):
        have = counts.sum(axis=tuple(range(4 - order)))
        strength = 5.0 * order
        shorter = (have + strength * shorter) / (have.sum(axis=-1, keepdims=True) + strength)
    return np.log(shorter).astype(np.float32).ravel()


def corpus_model(docs: DataFrame) -> np.ndarray:
    """The language model of all whole texts of ``docs``; each task sums its own counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for rows in batches:
            for _, texts in blocks(rows["text"].to_pylist()):
                total += gram_counts(texts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": some, "n": total[some]})

    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = rows.toPandas()  # SYMBOLS ** 4 rows at most
    counts = np.zeros(SYMBOLS**4)
    counts[table["gram"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
    return language_model(counts)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each step the signs that may be meant, with the log probability of writing them so."""
    steps: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(word):
        sign, end = word[at], at + 1
        while end < len(word) and word[end] == sign:
            end += 1
        run, at = end - at, end
        if sign.isalpha():
            if run >= 3:
                steps += [[(sign, 0.0)], [("", ONE_OF_RUN), (sign, ONE_OF_RUN)]]
            elif run == 2:
                steps += [[(sign, 0.0)], [("", ONE_OF_TWO), (sign, BOTH_OF_TWO)]]
            else:
                steps += [[(sign, 0.0)]]
        elif sign in READINGS:
            ways = [(x, AS_LETTER - log(len(READINGS[sign]))) for x in READINGS[sign]]
            steps += [[*ways, ("", LEFT_OUT), (" ", AS_BLANK)]] * min(run, 2)
        else:
            steps.append([("", BETWEEN), (" ", BETWEEN)])
    return steps


def restore(word: str, model: np.ndarray) -> str:
    """The most likely plain reading of a disguised word, maybe several words."""
    square, cube = SYMBOLS**2, SYMBOLS**3
    table = folded()
    best: dict[int, tuple[float, str]] = {0: (0.0, "")}
    for step in lattice(word):
        after: dict[int, tuple[float, str]] = {}
        for context, (score, said) in best.items():
            for sign, cost in step:
                if sign == " " and context % SYMBOLS == 0:
                    sign = ""
                if sign:
                    point = ord(sign)
                    symbol = int(table[point]) if point < LIMIT else 0
                    code = context * SYMBOLS + symbol
                    state, total, text = code % cube, score + cost + float(model[code]), said + sign
                else:
                    state, total, text = context, score + cost, said
                held = after.get(state)
                if held is None or total > held[0] or (total == held[0] and text < held[1]):
                    after[state] = (total, text)
        best = after
    ends = [(score + float(model[context * SYMBOLS]), said) for context, (score, said) in best.items()]
    return min(ends, key=lambda x: (-x[0], x[1]))[1]


@cache
def readable() -> np.ndarray:
    out = np.zeros(LIMIT, bool)
    out[[ord(x) for x in READINGS]] = True
    return out


def likelihood(words: np.ndarray, sizes: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Log probability of each run of symbols, ``sizes`` long, up to the blank after it."""
    padded = np.zeros(len(words) + 4 * len(sizes), np.int64)
    starts = np.cumsum(sizes + 4) - sizes - 1
    padded[np.arange(len(words)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)] = words
    code = ((padded[:-3] * SYMBOLS + padded[1:-2]) * SYMBOLS + padded[2:-1]) * SYMBOLS + padded[3:]
    total = np.concatenate([[0.0], np.cumsum(model[code].astype(np.float64))])
    return total[starts + sizes + 1 - 3] - total[starts - 3]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _among(hashes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(hashes), bool)
    return ordered[np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)] == hashes


class Reader:
    """Words of texts, disguised ones restored. Restored words are remembered, up to a bound."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, np.ndarray] = {}

    def hashes(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            plain = restore(word, self.model).split()
            points, offsets = flatten(plain)
            found = run_hashes(points, offsets[:-1], np.diff(offsets)) if plain else np.zeros(0, np.uint64)
            self.known[word] = found
        return found

    def _add(self, out_text: list, out_hash: list, out_before: list, word: str, text: int, before: np.uint64) -> None:
        got = self.hashes(word.lower())
        out_text.append(np.full(len(got), text))
        out_hash.append(got)
        out_before.append(np.full(len(got), before, np.uint64))

    def read(self, texts: list[str], known: np.ndarray | None = None, usual: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(text number, word hash, hash of the word before, writing) of every word, restored ones last.

        With ``known``, sorted hashes, words that are doubled or split are looked at only
        if the restored word is one of them. ``writing`` names how such a word is written, and is 0
        for others; writings in ``usual`` are words of their own and are not restored.
        """
        kind, lower, _ = tables()
        points, offsets = flatten(texts)
        empty = np.zeros(0, np.uint64)
        nothing = (np.zeros(0, np.int64), empty, empty, empty)
        if not len(points):
            return nothing
        kinds = kind[points]
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        solid = np.flatnonzero(kinds != SPACE)
        if not len(solid):
            return nothing
        # A chunk is what stands between white space, without signs at its ends that mean nothing.
        chunk_new = np.ones(len(solid), bool)
        chunk_new[1:] = (np.diff(solid) > 1) | (text[solid[1:]] != text[solid[:-1]])
        begin, end = solid[chunk_new], solid[np.append(chunk_new[1:], True)] + 1
        alnum = (kinds == LETTER) | (kinds == DIGIT)
        money = (points == ord("$")) | (points == ord("@"))
        single = money.copy()
        single[1:] &= points[1:] != points[:-1]
        single[:-1] &= points[:-1] != points[1:]
        hold = np.flatnonzero(alnum | single)
        first = np.searchsorted(hold, begin)
        last = np.searchsorted(hold, end) - 1
        some = first <= last
        chunk_begin, chunk_end = begin[some], end[some]
        begin, end = hold[first[some]], hold[last[some]] + 1
        if not len(begin):
            return nothing
        letters = np.concatenate([[0], np.cumsum(kinds == LETTER)])
        thrice = np.zeros(len(points), np.int64)
        thrice[2:] = (lower[points[2:]] == lower[points[1:-1]]) & (lower[points[1:-1]] == lower[points[:-2]]) & (kinds[2:] == LETTER)
        triples = np.concatenate([[0], np.cumsum(thrice)])
        size = end - begin
        n_letters = letters[end] - letters[begin]
        odd = ((n_letters >= 1) & (n_letters < size) & (size > 2)) | ((size > 2) & (triples[end] > triples[np.minimum(begin + 2, end)]))
        plain = (n_letters == size) & ~odd
        word_text = text[begin]
        # Hash of every chunk's letters and signs in lower case, chunk after chunk.
        flat = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        sums = run_sums(lower[points[flat]], np.cumsum(size) - size, size)
        with np.errstate(over="ignore"):
            found = mix(sums + size.astype(np.uint64))
        before = np.zeros(len(found), np.uint64)
        before[1:] = np.where(word_text[1:] == word_text[:-1], found[:-1], 0)
        out_text, out_hash, out_before = [word_text[plain]], [found[plain]], [before[plain]]
        written: list[tuple[int, np.ndarray]] = []  # place in the lists above, names of writings
        raw = None
        for at in np.flatnonzero(odd).tolist():
            raw = raw or "".join(texts)
            got = self.hashes(raw[begin[at] : end[at]].lower())
            out_text.append(np.full(len(got), word_text[at]))
            out_hash.append(got)
            out_before.append(np.full(len(got), before[at], np.uint64))
        # Signs at the ends that may be letters, and letters written twice, give one more reading.
        mute = np.flatnonzero(~readable()[points])
        after = np.append(mute, len(points))[np.searchsorted(mute, end)]
        ahead = np.append(mute, -1)[np.searchsorted(mute, begin) - 1] + 1
        wide_begin = np.maximum(chunk_begin, np.minimum(begin, ahead))
        wide_end = np.minimum(chunk_end, np.maximum(end, after))
        # Marks after a word, and more than two signs in a row, are no letters.
        marks = np.isin(points[np.minimum(end, len(points) - 1)], MARKS)
        wide_end = np.where(marks | (wide_end - end > 2), end, wide_end)
        wide_begin = np.where(begin - wide_begin > 2, begin, wide_begin)
        twice = np.zeros(len(points), np.int64)
        twice[1:] = (lower[points[1:]] == lower[points[:-1]]) & (kinds[1:] == LETTER)
        doubles = np.concatenate([[0], np.cumsum(twice)])
        n_doubles = doubles[end] - doubles[np.minimum(begin + 1, end)]
        again = plain & (size > 2) & (n_doubles > 0)
        symbols = folded()[points].astype(np.int64)
        i = np.flatnonzero(again)
        if known is not None and len(i):
            once = n_doubles[i] == 1
            flat, owner = _ranges(begin[i], size[i]), np.repeat(np.arange(len(i)), size[i])
            stays = ~((twice[flat] > 0) & (flat > begin[i][owner]))
            length = np.bincount(owner[stays], minlength=len(i))
            less = run_hashes(lower[points[flat[stays]]], np.cumsum(length) - length, length)
            again[i] = _among(less, known) | ~once
            if usual is not None:
                again[i] &= ~_among(found[i], usual)
            i = np.flatnonzero(again)
        if len(i):
            # Only words that are likelier without one of their double letters, or without any.
            flat, owner = _ranges(begin[i], size[i]), np.repeat(np.arange(len(i)), size[i])
            extra = (twice[flat] > 0) & (flat > begin[i][owner])
            less = ONE_OF_TWO - BOTH_OF_TWO + likelihood(symbols[flat[~extra]], size[i] - n_doubles[i], self.model)
            usual = likelihood(symbols[flat], size[i], self.model)
            helps = less > usual
            several = n_doubles[i] > 1
            if several.any():
                of = np.repeat(np.arange(len(i)), np.where(several, n_doubles[i], 0))
                left_out = flat[extra & several[owner]]
                all_of = _ranges(begin[i[of]], size[i[of]])
                kept = all_of[all_of != np.repeat(left_out, size[i[of]])]
                one = ONE_OF_TWO - BOTH_OF_TWO + likelihood(symbols[kept], size[i[of]] - 1, self.model)
                np.logical_or.at(helps, of, one > usual[of])
            single = helps & ~several
            length = size[i][single] - 1
            out_text.append(word_text[i[single]])
            written.append((len(out_hash), found[i[single]]))
            out_hash.append(run_hashes(lower[points[flat[~extra & single[owner]]]], np.cumsum(length) - length, length))
            out_before.append(before[i[single]])
            again[i] = helps & several
        wider = (n_letters >= 1) & ((wide_begin < begin) | (wide_end > end)) & (wide_end - wide_begin > 2)
        for at in np.flatnonzero(again | wider).tolist():
            raw = raw or "".join(texts)
            if again[at]:
                self._add(out_text, out_hash, out_before, raw[begin[at] : end[at]], word_text[at], before[at])
            if wider[at]:
                self._add(out_text, out_hash, out_before, raw[wide_begin[at] : wide_end[at]], word_text[at], before[at])
        # Neighbours that are likelier as one word.
        for pieces in range(2, PIECES + 1):
            if len(begin) < pieces:
                break
            n = len(begin) - pieces + 1
            sizes = sum(size[k : k + n] for k in range(pieces))
            near = (word_text[:n] == word_text[pieces - 1 :]) & (sizes <= JOINED) & (sizes > 2)
            for k in range(pieces):
                near &= n_letters[k : k + n] >= 1
            simple = near.copy()
            for k in range(pieces):
                simple &= plain[k : k + n]
            i = np.flatnonzero(simple)
            name = found[i]
            with np.errstate(over="ignore"):
                for k in range(1, pieces):
                    name = mix(name + np.uint64(k)) + found[i + k]
            if known is not None and len(i):
                whole, so_far = sums[i].copy(), size[i].copy()
                with np.errstate(over="ignore"):
                    for k in range(1, pieces):
                        whole += powers(JOINED)[so_far - 1] * sums[i + k]
                        so_far += size[i + k]
                    some = _among(mix(whole + so_far.astype(np.uint64)), known)
                if usual is not None:
                    some &= ~_among(name, usual)
                i, name = i[some], name[some]
            if len(i):
                flat = np.concatenate([_ranges(begin[i + k], size[i + k]) for k in range(pieces)])
                owner = np.concatenate([np.repeat(np.arange(len(i)), size[i + k]) for k in range(pieces)])
                flat = flat[np.argsort(owner, kind="stable")]
                apart = np.stack([size[i + k] for k in range(pieces)], axis=1) + (np.arange(pieces) < pieces - 1)
                spaced = np.zeros(int(apart.sum()), np.int64)
                ends = np.cumsum(apart.ravel())
                letter = np.ones(len(spaced), bool)
                letter[ends[np.arange(len(ends)) % pieces < pieces - 1] - 1] = False
                spaced[letter] = symbols[flat]
                one = likelihood(symbols[flat], sizes[i], self.model) + (pieces - 1) * SPLIT
                better = one > likelihood(spaced, apart.sum(axis=1), self.model)
                keep = np.repeat(better, sizes[i])
                length = sizes[i][better]
                out_text.append(word_text[i[better]])
                written.append((len(out_hash), name[better]))
                out_hash.append(run_hashes(lower[points[flat[keep]]], np.cumsum(length) - length, length))
                out_before.append(before[i[better]])
            for at in np.flatnonzero(near & ~simple).tolist():
                raw = raw or "".join(texts)
                word = "-".join(raw[begin[k] : end[k]] for k in range(at, at + pieces))
                self._add(out_text, out_hash, out_before, word, word_text[at], before[at])
        lone = size == 1
        starts = np.flatnonzero(lone & ~np.concatenate([[False], lone[:-1] & (word_text[:-1] == word_text[1:])]))
        stops = np.flatnonzero(lone & ~np.concatenate([lone[1:] & (word_text[:-1] == word_text[1:]), [False]])) + 1
        for a, b in zip(starts[stops - starts >= SPACED].tolist(), stops[stops - starts >= SPACED].tolist(), strict=True):
            raw = raw or "".join(texts)
            got = self.hashes("-".join(raw[begin[i]] for i in range(a, b)).lower())
            out_text.append(np.full(len(got), word_text[a]))
            out_hash.append(got)
            out_before.append(np.full(len(got), before[a], np.uint64))
        writing = [np.zeros(len(h), np.uint64) for h in out_hash]
        for place, names in written:
            writing[place] = names
        return np.concatenate(out_text).astype(np.int64), np.concatenate(out_hash), np.concatenate(out_before), np.concatenate(writing)


def distinct(text: np.ndarray, hashes: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct combinations, in order."""
    if not len(text):
        return (text, hashes, *more)
    columns = (text, hashes, *more)
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(text), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return tuple(c[new] for c in columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic) of at most ``size`` documents of each class that are not held out.

    The ones with the lowest hash of their doc_id, taken within salts and then among the
    salts' best; a document with several labels is toxic if one says so.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.max("toxic") >= 1).cast("long").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    inner = Window.partitionBy("toxic", F.pmod("h", F.lit(SALTS))).orderBy("h", "doc_id")
    outer = Window.partitionBy("toxic").orderBy("h", "doc_id")
    chosen = (
        known.withColumn("n", F.row_number().over(inner)).filter(F.col("n") <= size)
        .withColumn("n", F.row_number().over(outer)).filter(F.col("n") <= size)
        .select("doc_id", "toxic")
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # 2 x size rows


def word_odds(sample: DataFrame, model, texts: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, log odds) of the words that mark toxic texts.

    A word counts if it is in ``MIN_CONTEXTS`` toxic texts, in as many different contexts
    (so that copies of one text count once), and its odds are surely high.
    """
    n_clean, n_toxic = texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for rows in batches:
            toxic = rows["toxic"].to_numpy()
            for start, held in blocks(rows["text"].to_pylist()):
                text, found, *_ = reader.read(held)
                text, found = distinct(text, found)
                words, at = np.unique(found, return_inverse=True)
                bad = np.bincount(at, weights=toxic[start + text], minlength=len(words)).astype(np.int64)
                every = np.bincount(at, minlength=len(words))
                yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "bad": bad, "good": every - bad})

    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.col("good") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    words = (
        sample.mapInArrow(count, "word long, bad long, good long").groupBy("word")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter(F.col("bad") >= MIN_CONTEXTS).withColumn("odds", odds)
        .filter(F.col("odds") - MARGIN * error >= MIN_ODDS)
        .select("word", "odds").toPandas()  # distinct words of the toxic sample / MIN_CONTEXTS rows at most
    )
    candidates = np.sort(words["word"].to_numpy(np.int64).view(np.uint64))
    if not len(candidates):
        return candidates, np.zeros(0)
    sent = sample.sparkSession.sparkContext.broadcast(candidates)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for rows in batches:
            for _, held in blocks(rows["text"].to_pylist()):
                _, found, before, _ = reader.read(held)
                at = np.minimum(np.searchsorted(sent.value, found), len(sent.value) - 1)
                some = sent.value[at] == found
                word, context = distinct(found[some], before[some])
                yield pa.RecordBatch.from_pydict({"word": word.view(np.int64), "context": context.view(np.int64)})

    wide = (
        sample.filter("toxic = 1").mapInArrow(contexts, "word long, context long").distinct()
        .groupBy("word").count().filter(F.col("count") >= MIN_CONTEXTS).toPandas()
    )
    kept = words.merge(wide, on="word")
    keys = kept["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.minimum(kept["odds"].to_numpy()[order], MOST_ODDS)


def usual_writings(sample: DataFrame, model, keys: np.ndarray) -> np.ndarray:
    """Sorted names of the doubled or split writings of marked words that clean texts hold; these are words of their own."""
    if not len(keys):
        return keys

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for rows in batches:
            for _, held in blocks(rows["text"].to_pylist()):
                _, found, _, writing = reader.read(held, keys)
                yield pa.RecordBatch.from_pydict({"writing": np.unique(writing[(writing != 0) & _among(found, keys)]).view(np.int64)})

    rows = sample.filter("toxic = 0").mapInArrow(find, "writing long").distinct().toPandas()  # of a bounded sample
    return np.sort(rows["writing"].to_numpy(np.int64).view(np.uint64))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score of ``THRESHOLD`` or more).

    The language model comes from all texts, the words from ``labels`` (doc_id, toxic)
    without the held-out part. Null and empty texts, and texts without a marked word, get
    one low score; so do all texts if there are no labels of one class.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(corpus_model(docs))
    sample = saved(labelled_sample(docs, labels, sample_docs), "labelled")
    sizes = dict(sample.groupBy("toxic").count().collect())  # two rows
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    keys, odds = word_odds(sample, model, (n_clean, n_toxic)) if n_clean and n_toxic else (np.zeros(0, np.uint64), np.zeros(0))
    share = labels.filter(~held_out(F.col("doc_id"))).agg(F.avg((F.col("toxic") >= 1).cast("int"))).first()[0] or 0.0
    share = min(max(share, 0.001), 0.2)
    prior = log(share / (1 - share)) - 1
    learned = spark.sparkContext.broadcast((keys, odds, usual_writings(sample, model, keys)))

    @F.pandas_udf("score double, predicted int")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.value)
        words, weights, usual = learned.value
        for texts in parts:
            scores = np.full(len(texts), prior)
            for start, held in blocks(texts.where(texts.notna(), None)):
                text, found, *_ = reader.read(held, words, usual)
                if len(found) and len(words):
                    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
                    some = words[at] == found
                    doc, word = distinct(text[some], at[some].astype(np.uint64))
                    np.add.at(scores, start + doc, weights[word.astype(np.int64)])
            value = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            yield pd.DataFrame({"score": value, "predicted": (value >= THRESHOLD).astype(np.int32)})

    return docs.withColumn("_found", score("text")).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")], "_found.*"
    )
