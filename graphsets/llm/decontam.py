"""Benchmark items in documents, also with other numbers, names and units.

Words become templates: numbers, names and units turn into typed placeholders. Windows
of two to five template words, as an item's length needs, are hash joined with those of the
benchmark and aligned along the document; the aligned words are compared one by one, and
the values behind the placeholders must be replaced consistently.
The benchmark's windows are joined in blocks of bounded size; each block is sent to
all tasks, so documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsets.llm.codes import DIGIT, LETTER, LIMIT, UNSPACED, blocks, flatten, mix, run_hashes, tables, unspaced, windows
from graphsets.llm.prefix import running_sums
from graphsets.llm.store import saved

WIDTH = 5  # the widest window
COVERAGE = 0.8  # of an item's words
CONSISTENCY = 0.8
SLACK = 8  # words by which an alignment may shift from one window to the next
COMPARED = 2_000_000  # pairs of words that are compared at once
BLOCK_WORDS = 500_000  # words of the benchmark that are sent to tasks at once, up to the end of the item they lie in
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
ENDS = ".!?:;\n\"(。！？：；（「…"  # of sentences

UNITS = tuple((
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
    "pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes "
    "hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers "
    "kilometre kilometres mph kmh dollar dollars cent cents euro euros percent degree degrees watt watts kw mb gb tb"
).split())
NUMBERS = tuple((
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split())


@cache
def _lexicon(entries: tuple[str, ...]) -> np.ndarray:
    points, offsets = flatten(entries)
    return np.sort(run_hashes(points, offsets[:-1], np.diff(offsets)))


@cache
def _ends() -> np.ndarray:
    """Which code points end a sentence."""
    out = np.zeros(LIMIT, bool)
    out[[ord(c) for c in ENDS]] = True
    return out


@dataclass
class Words:
    """Words of a block of texts: text number, hash, and whether the word begins a text, line or
    sentence, is a number or a unit, or looks like a name."""

    text: np.ndarray
    value: np.ndarray
    opens: np.ndarray
    number: np.ndarray
    unit: np.ndarray
    named: np.ndarray


@dataclass
class Templates:
    """Template words of a block of texts: text number, template hash, value hash, kind, and
    whether the word begins a text, line or sentence."""

    text: np.ndarray
    template: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    opens: np.ndarray


def _isin(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def cut_words(texts: list[str]) -> Words:
    """A word is a run of letters, or of digits with inner points and commas; in scripts without blanks each letter is one.

    Numbers are digits and number words; a unit follows a number; what begins with a
    capital letter and goes on in small ones looks like a name.
    """
    kinds, lower, upper = tables()
    points, offsets = flatten(texts)
    no = np.zeros(0, bool)
    nothing = Words(np.zeros(0, np.int64), np.zeros(0, np.uint64), no, no, no, no)
    if not len(points):
        return nothing
    kind = kinds[points]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    digit = kind == DIGIT
    inner = np.zeros(len(points), bool)
    inner[1:-1] = ((points[1:-1] == ord(".")) | (points[1:-1] == ord(","))) & digit[:-2] & digit[2:] & (text[:-2] == text[2:])
    group = np.where(kind == LETTER, 1, np.where(digit | inner, 2, 0))
    at = np.flatnonzero(group)
    if not len(at):
        return nothing
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (group[at[1:]] != group[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    alone = unspaced()[points[at]]
    new |= alone
    new[1:] |= alone[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(at)))
    value = run_hashes(lower[points[at]], starts, lengths)
    word_text = text[at][starts]
    # Signs between a word and the one before: the sentence ends if one of them ends it.
    ended = np.concatenate([[0], np.cumsum(_ends()[points] & (group == 0))])
    begin, finish = at[starts], at[starts] + lengths
    opens = np.ones(len(starts), bool)
    opens[1:] = (word_text[1:] != word_text[:-1]) | (ended[begin[1:]] > ended[finish[:-1]])
    capital = upper[points[at]]
    named = capital[starts] & (np.add.reduceat(capital.astype(np.int64), starts) == 1) & (lengths > 1)
    number = (group[at][starts] == 2) | _isin(value, _lexicon(NUMBERS))
    unit = np.zeros(len(starts), bool)
    after = np.flatnonzero(number[:-1] & (word_text[1:] == word_text[:-1])) + 1
    unit[after] = _isin(value[after], _lexicon(UNITS))
    return Words(word_text, value, opens, number, unit, named)


def typed_words(words: Words, names: bool = True, openers: bool = False) -> Templates:
    """Names are words that look so and do not begin a text, line or sentence; names in a row are one placeholder.

    Without ``names`` they are plain words; with ``openers`` words that begin a text,
    line or sentence are names, too, if they look so.
    """
    text, value, opens = words.text, words.value, words.opens
    is_name = names & words.named & (openers | ~opens)
    kind = np.where(words.number, NUMBER, np.where(words.unit, UNIT, np.where(is_name, NAME, WORD))).astype(np.int8)
    same_name = np.zeros(len(text), bool)
    same_name[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & ~opens[1:]
    if same_name.any():
        heads = np.flatnonzero(~same_name)
        with np.errstate(over="ignore"):
            value = np.add.reduceat(value, heads)  # a single word keeps its value
        kind, text, opens = kind[heads], text[heads], opens[heads]
    marks = mix(np.arange(77, 81, dtype=np.uint64))
    return Templates(text, np.where(kind == WORD, value, marks[kind]), value, kind, opens)


def templates(texts: list[str], names: bool = True, openers: bool = False) -> Templates:
    """The template words of ``texts``."""
    return typed_words(cut_words(texts), names, openers)


def literal_windows(words: Templates, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of windows of ``width`` words that hold a word besides placeholders.

    A window of placeholders alone says nothing; its values are taken instead.
    """
    text, first, found = windows(words.text, words.template, width)
    if not len(text):
        return text, first, found
    plain = np.concatenate([[0], np.cumsum(words.kind == WORD)])
    last = np.minimum(first + width, np.searchsorted(words.text, text, side="right"))
    bare = plain[last] == plain[first]
    if bare.any():
        found = np.where(bare, mix(windows(words.text, words.value, width)[2] + np.uint64(5)), found)
    whole = last - first == width
    return text[whole], first[whole], found[whole]


def sentence_runs(words: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``literal_windows``, of whole sentences and lines, one or several, of fewer than ``WIDTH`` words."""
    ends = np.append(words.opens[1:], True)
    parts = []
    for size in range(1, WIDTH):
        first = np.flatnonzero(words.opens[: max(0, len(words.text) - size + 1)])
        first = first[ends[first + size - 1] & (words.text[first] == words.text[first + size - 1])]
        runs, at = np.repeat(np.arange(len(first)), size), (first[:, None] + np.arange(size)).ravel()
        found = windows(runs, words.template[at], WIDTH)[2]
        bare = (words.kind[at].reshape(-1, size) != WORD).all(axis=1)
        if bare.any():
            found = np.where(bare, mix(windows(runs, words.value[at], WIDTH)[2] + np.uint64(5)), found)
        parts.append((words.text[first], first, found))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def window_widths(sizes: np.ndarray, coverage: float) -> np.ndarray:
    """The window width for items of ``sizes`` words; 0 stands for whole sentences.

    Of n words at most k may differ, so k + 1 runs of equal words hold n - k words, and the
    longest has this width at least.
    """
    differ = np.floor((1 - coverage) * sizes + 1e-9).astype(np.int64)
    widths = np.clip(-(-(sizes - differ) // (differ + 1)), 2, WIDTH)
    return np.where(sizes < WIDTH, 0, widths)


class Index:
    """The windows of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str], names: bool = True, openers: bool = False, coverage: float = COVERAGE):
        self.ids, self.names, self.openers = ids, names, openers
        self.words = templates(texts, names, openers)
        self.begin = np.searchsorted(self.words.text, np.arange(len(ids)))
        self.sizes = np.bincount(self.words.text, minlength=len(ids))
        self.widths = window_widths(self.sizes, coverage)
        self.windows = np.where(self.widths > 0, self.sizes - self.widths + 1, np.minimum(self.sizes, 1))
        self.tables = {}
        for width in np.unique(self.widths[self.sizes > 0]).tolist():
            item, first, found = literal_windows(self.words, width) if width else sentence_runs(self.words)
            mine = self.widths[item] == width
            if not width:
                mine &= self._whole(item, first)
            item, first, found = item[mine], first[mine], found[mine]
            order = np.argsort(found, kind="stable")
            # Most windows of documents are in no item: a table of leading bits tells so before the search.
            shift = np.uint64(64 - max(16, int(16 * len(found)).bit_length()))
            marks = np.zeros(1 << (64 - int(shift)), bool)
            marks[found >> shift] = True
            self.tables[width] = found[order], item[order], first[order], marks, shift

    def _whole(self, item: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of the runs of short items, the ones of all their words: the last from the first word on."""
        whole = np.zeros(len(item), bool)
        some = np.flatnonzero(first == self.begin[item])
        whole[some[len(some) - 1 - np.unique(item[some][::-1], return_index=True)[1]]] = True
        return whole

    def _hits(self, words: Templates) -> tuple[np.ndarray, ...]:
        """(text, item, window's first word in the item, in the text, width) of equal windows."""
        parts = [(np.zeros(0, np.int64),) * 5]
        for width, (hashes, items, firsts, marks, shift) in self.tables.items():
            text, first, found = literal_windows(words, width) if width else sentence_runs(words)
            likely = np.flatnonzero(marks[found >> shift])
            text, first, found = text[likely], first[likely], found[likely]
            left = np.searchsorted(hashes, found, side="left")
            hit = np.flatnonzero((left < len(hashes)) & (hashes[np.minimum(left, len(hashes) - 1)] == found))
            counts = np.searchsorted(hashes, found[hit], side="right") - left[hit]
            at = np.repeat(left[hit], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = np.repeat(hit, counts)
            wide = np.full(len(at), width) if width else self.sizes[items[at]]
            parts.append((text[hit], items[at], firsts[at], first[hit], wide))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _agree(self, words: Templates, p: np.ndarray, q: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether item words ``p`` equal document words ``q``, in runs that begin at ``starts``.

        Placeholders without an equal plain word near by need equal values.
        """
        inside = (q >= 0) & (q < len(words.text))
        at = np.where(inside, q, 0)
        same = inside & (words.text[at] == doc) & (words.template[at] == self.words.template[p])
        plain = self.words.kind[p] == WORD
        equal = np.concatenate([[0], np.cumsum(same & plain)])
        lengths = np.diff(np.append(starts, len(p)))
        begin, end = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
        rows = np.arange(len(p))
        near = equal[np.minimum(rows + WIDTH, end)] > equal[np.maximum(rows - WIDTH + 1, begin)]
        return same & (plain | near | (words.value[at] == self.words.value[p]))

    def _most(self, words: Templates, doc: np.ndarray, item: np.ndarray, shift: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` alignments how many of the item's words agree at any of its shifts."""
        out = np.zeros(n, np.int64)
        sizes = self.sizes[item]
        total = np.cumsum(sizes)
        at = 0
        while at < len(item):
            # Whole alignments, of about COMPARED words together.
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COMPARED, side="right")))
            to = int(np.searchsorted(segment, segment[to - 1], side="right"))
            size = sizes[at:to]
            starts = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(starts, size)
            p = np.repeat(self.begin[item[at:to]], size) + step
            good = self._agree(words, p, p + np.repeat(shift[at:to], size), np.repeat(doc[at:to], size), starts)
            which, p = np.repeat(segment[at:to], size)[good], p[good]
            order = np.lexsort((p, which))
            which, p = which[order], p[order]
            new = np.ones(len(p), bool)
            new[1:] = (which[1:] != which[:-1]) | (p[1:] != p[:-1])
            out += np.bincount(which[new], minlength=n)
            at = to
        return out

    def search(self, texts: list[str] | Words, coverage: float, consistency: float) -> list[tuple]:
        """(text, item, matched windows, slots, consistent slots, equal slots, first word, last word, aligned words).

        Texts and items are given by number.
        """
        cut = texts if isinstance(texts, Words) else cut_words(texts)
        words = typed_words(cut, self.names, self.openers)
        if not len(words.text) or not self.tables:
            return []
        doc, item, there, here, wide = self._hits(words)
        if not len(doc):
            return []
        shift = here - there
        order = np.lexsort((there, shift, item, doc))
        doc, item, there, here, wide, shift = doc[order], item[order], there[order], here[order], wide[order], shift[order]
        other = np.ones(len(doc), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        new = other.copy()
        new[1:] |= np.diff(shift) > SLACK
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(doc))
        # A word that differs spoils ``width`` windows at most; half of the others may be lost to words put in.
        size, width = self.sizes[item[begins]], wide[begins]
        least = (size - width + 1 - np.floor((1 - coverage) * size + 1e-9) * width) / 2
        enough = ends - begins >= least
        segment = np.cumsum(new) - 1
        first_of_shift = new.copy()
        first_of_shift[1:] |= shift[1:] != shift[:-1]
        diagonal = np.flatnonzero(first_of_shift & enough[segment])
        most = self._most(words, doc[diagonal], item[diagonal], shift[diagonal], segment[diagonal], len(begins))
        enough &= most >= coverage * size - 1e-9
        out: dict[tuple[int, int], tuple] = {}
        for a, b in zip(begins[enough].tolist(), ends[enough].tolist(), strict=True):
            # Each word of the item stands for the word at its most usual shift, a word in no
            # window for the one at the shift of the next word that is in one.
            shifts, which, usual = np.unique(shift[a:b], return_inverse=True, return_counts=True)
            n, begin = int(self.sizes[item[a]]), int(self.begin[item[a]])
            steps = np.arange(int(wide[a]))
            held = (there[a:b, None] + steps).ravel()
            by = np.repeat(which, len(steps))
            order = np.lexsort((by, -usual[by], held))
            held, by = held[order], by[order]
            head = np.append(True, held[1:] != held[:-1])
            held, by = held[head], by[head]
            p = np.arange(begin, begin + n)
            after = np.minimum(np.searchsorted(held, p), len(held) - 1)
            before = np.maximum(after - 1, 0)
            nearest = np.where(np.abs(held[before] - p) < np.abs(held[after] - p), before, after)
            q = p + shifts[by[nearest]]
            good_words = self._agree(words, p, q, np.full(n, doc[a]), np.zeros(1, np.int64))
            aligned = int(good_words.sum())
            if aligned < coverage * n - 1e-9:
                continue
            p, q = p[good_words], q[good_words]
            first_word, last_word = int(q.min() - words_begin(words, doc[a])), int(q.max() - words_begin(words, doc[a]) + 1)
            slot = self.words.kind[p] != WORD
            p, q = p[slot], q[slot]
            slots, good, equal = 0, 0, 0
            if len(p):
                mapped = np.unique(np.stack([self.words.value[p], words.value[q]]), axis=1)
                # Different values may become the same one: small numbers coincide often.
                theirs, n_theirs = np.unique(mapped[0], return_counts=True)
                single = (n_theirs == 1)[np.searchsorted(theirs, mapped[0])]
                slots, good = len(theirs), int(single.sum())
                equal = int((single & (mapped[0] == mapped[1])).sum())
            if good < consistency * slots:
                continue
            row = (len(np.unique(there[a:b])), slots, good, equal, first_word, last_word, aligned)
            key = (int(doc[a]), int(item[a]))
            if key not in out or row[-1] > out[key][-1]:
                out[key] = row
        return [(*key, *row) for key, row in out.items()]


class Searcher:
    """An index that knows names by their capitals; where they differ, one that takes sentence
    openers for names, too, and one for texts in other letters."""

    def __init__(self, ids: list, texts: list[str], coverage: float = COVERAGE):
        self.indexes = [Index(ids, texts, coverage=coverage)]
        opened = Index(ids, texts, openers=True, coverage=coverage)
        if not np.array_equal(opened.words.template, self.indexes[0].words.template):
            self.indexes.append(opened)
        if (self.indexes[0].words.kind == NAME).any():
            self.indexes.append(Index(ids, texts, names=False, coverage=coverage))
        self.ids = ids

    def search(self, texts: list[str], coverage: float, consistency: float) -> list[tuple]:
        """As Index.search, with the item's windows after its number and its words at the end; the best index counts."""
        best: dict[tuple[int, int], tuple] = {}
        cut = cut_words(texts)
        for index in self.indexes:
            for text, item, *row in index.search(cut, coverage, consistency):
                size = int(index.sizes[item])
                held = best.get((text, item))
                if held is None or row[-1] * held[-1] > held[-2] * size:
                    best[text, item] = (int(index.windows[item]), *row, size)
        return [(*key, *row) for key, row in sorted(best.items())]


def words_begin(words: Templates, text: int) -> int:
    return int(np.searchsorted(words.text, text))


SCHEMA = (
    "doc_id long, text_hash long, item_id long, windows long, matched long, slots long, consistent long, "
    "kind string, first_word long, last_word long, aligned long, words long"
)


def _word_count(text: Column) -> Column:
    """About how many words a text has: runs of letters and digits, and each sign of scripts without blanks."""
    alone = "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in UNSPACED)
    return F.regexp_count(text, F.lit(rf"[{alone}]|[\p{{L}}\p{{N}}&&[^{alone}]]+")).cast("long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """One row for each document (doc_id, text) and benchmark item (item_id, text) that it holds.

    A document holds an item if in one alignment it has ``coverage`` of the item's
    words (placeholders for placeholders), and ``consistency`` of the item's placeholder values each stand for one value
    of the document throughout. ``kind`` is ``verbatim`` if all values are equal, else
    ``reparameterised``. Items of fewer than five words must stand as sentences or lines of
    their own, with all their words. Null and empty texts hold nothing and are in nothing. Rows that
    are alike give one row each; the best alignment of a document and item counts, ties to
    the first.
    """
    spark = docs.sparkSession
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), "text", _word_count(F.col("text")).alias("_words"))
    placed = running_sums(items, ["item_id", "text"], {"_start": "_words"})
    dealt = saved(placed.select("item_id", "text", F.expr(f"_start div {BLOCK_WORDS}").alias("_block")), "benchmark")
    found = []
    for part in range((dealt.agg(F.max("_block")).first()[0] or 0) + 1):
        rows = dealt.filter(F.col("_block") == part).select("item_id", "text").orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        found.append(
            docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(_searcher(index, coverage, consistency), SCHEMA)
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _searcher(index, coverage: float, consistency: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Searcher(*index.value, coverage)
        for rows in batches:
            out = []
            for start, texts in blocks(rows["text"].to_pylist()):
                for text, item, size, matched, slots, good, equal, first, last, aligned, length in here.search(texts, coverage, consistency):
                    at = start + text
                    out.append(
                        (rows["doc_id"][at].as_py(), rows["text_hash"][at].as_py(), here.ids[item], size, matched,
                         slots, good, "verbatim" if equal == slots else "reparameterised", first, last, aligned, length)
                    )
            if out:
                columns = list(zip(*out, strict=True))
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array(c, pa.string() if n == "kind" else pa.int64()) for n, c in zip(names, columns, strict=True)}
                )

    return search


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns."""
    leaks = find_leaks(docs, benchmark, **limits).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    held = docs.withColumn("_name", F.xxhash64("text"))
    return held.join(leaks, held["doc_id"].eqNullSafe(leaks["_id"]) & (held["_name"] == leaks["_hash"]), "left_anti").drop("_name")
