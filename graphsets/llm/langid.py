"""Language of a text by cross parsing.

For each language a suffix automaton holds all substrings of a sample of labelled text.
A text is parsed into longest matches against each automaton; the language whose phrases
and letters outside its sample take the fewest bits for each letter wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.llm.codes import LETTER, blocks, flatten, tables

SAMPLE_CHARS = 40_000  # letters and blanks of each language's sample; the bound of the fit
ALL_SAMPLES = 200_000  # and of all languages together; with more languages each has a smaller sample, 2,000 at least
LETTERS, CLASSES = 190, 64  # letters with a symbol of their own; all others share these classes by code point
SAMPLE_TEXTS = 64
SALTS = 64
SEGMENT = 512  # characters that are parsed in step; each segment begins a new phrase
UNKNOWN = "und"
FEW_PHRASES = 8
SHORT_PHRASE = 1.25
LENGTH_BITS = 3.0  # for a phrase's length, besides its place in the sample
_AGAIN = np.int32(1 << 30)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def simplify(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case with one blank for each run of other signs, and each text's length."""
    kind, lower, _ = tables()
    points, offsets = flatten(texts)
    letters = kind[points] == LETTER
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    keep[offsets[:-1][offsets[:-1] < len(points)]] = letters[offsets[:-1][offsets[:-1] < len(points)]]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))[keep]
    return np.where(letters, lower[points], 32)[keep], np.bincount(text, minlength=len(texts))


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions [state, symbol] of the automaton of all substrings; 0 is the start, -1 no way on."""
    moves = np.full((2 * len(symbols) + 2, size), -1, np.int32)
    rows: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        here = len(rows)
        rows.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in rows[at]:
            rows[at][symbol] = here
            at = link[at]
        if at >= 0:
            there = rows[at][symbol]
            if length[at] + 1 == length[there]:
                link[here] = there
            else:
                copy = len(rows)
                rows.append(dict(rows[there]))
                length.append(length[at] + 1)
                link.append(link[there])
                link[there] = link[here] = copy
                while at >= 0 and rows[at].get(symbol) == there:
                    rows[at][symbol] = copy
                    at = link[at]
        last = here
    for state, row in enumerate(rows):
        for symbol, to in row.items():
            moves[state, symbol] = to
    return moves[: len(rows)]


@dataclass
class Model:
    """Languages, their alphabet and one parsing table for all of them.

    Symbol 0 fills segments up, 1 is any letter outside the alphabet. If the samples have
    more than ``LETTERS`` letters, the rarer ones share ``CLASSES`` symbols, so the table's
    size is bounded for any script. An entry holds the next row and, at the bit ``_AGAIN``,
    that a phrase ended before this symbol.
    """

    languages: list[str]
    alphabet: np.ndarray
    steps: np.ndarray
    roots: np.ndarray
    bits: np.ndarray
    shared: bool = False

    def outside(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Letters [text, language] that are not in the language's sample."""
        width = self.steps.shape[1]
        text = np.repeat(np.arange(len(lengths)), lengths)
        count = np.bincount(text * width + symbols, minlength=len(lengths) * width).reshape(-1, width)
        return count @ ((self.steps[self.roots] & ~_AGAIN) == self.roots[:, None]).T.astype(np.int64)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        other = points % CLASSES + len(self.alphabet) + 2 if self.shared else 1
        return np.where(self.alphabet[at] == points, at + 2, other).astype(np.int64)

    @staticmethod
    def fit(samples: dict[str, list[str]], chars: int = SAMPLE_CHARS) -> Model:
        """``samples``: texts of each language; the first ``chars`` signs of them all count."""
        chars = min(chars, max(2_000, ALL_SAMPLES // max(1, len(samples))))
        simple = {lang: simplify([" ".join(texts)])[0][:chars] for lang, texts in sorted(samples.items())}
        simple = {lang: x for lang, x in simple.items() if len(x)}
        alphabet, often = np.unique(np.concatenate([*simple.values(), np.array([32])]), return_counts=True)
        shared = len(alphabet) > LETTERS
        if shared:
            alphabet = np.sort(alphabet[np.argsort(-often, kind="stable")[:LETTERS]])
        size, parts, roots, base = len(alphabet) + 2 + shared * CLASSES, [], [], 0
        coder = Model([], alphabet, np.zeros(0), np.zeros(0), np.zeros(0), shared)
        for points in simple.values():
            moves = suffix_automaton(coder.symbols(points).tolist(), size)
            states = np.arange(len(moves), dtype=np.int32) + base
            fresh = np.where(moves[0] >= 0, moves[0] + base, base) | _AGAIN  # begins a phrase
            table = np.where(moves >= 0, moves + base, fresh[None, :]).astype(np.int32)
            table[0] = fresh
            table[:, 0] = states  # filler
            table[:, 1] = base | _AGAIN
            parts.append(table)
            roots.append(base)
            base += len(moves)
        bits = np.array([np.log2(max(2, len(x))) for x in simple.values()])
        steps = np.concatenate(parts) if parts else np.zeros((0, size), np.int32)
        return Model(list(simple), alphabet, steps, np.array(roots, np.int64), bits, shared)

    def phrases(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases [text, language]; long texts are parsed in segments side by side."""
        counts = -(-lengths // SEGMENT)
        n, langs = int(counts.sum()), len(self.languages)
        grid = np.zeros((n, SEGMENT), np.int64)
        first = np.cumsum(counts) - counts
        inside = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grid[np.repeat(first, lengths) + inside // SEGMENT, inside % SEGMENT] = symbols
        longest = int(min(SEGMENT, lengths.max(initial=0)))
        width = self.steps.shape[1]
        flat = self.steps.ravel()
        state = np.repeat(self.roots[None, :], n, axis=0).astype(np.int32).ravel()
        found = np.zeros(n * langs, np.int32)
        columns = np.ascontiguousarray(grid[:, :longest].T)
        for column in columns:
            to = flat[state * width + np.repeat(column, langs)]
            found += to >> 30
            state = to & ~_AGAIN
        text = np.repeat(np.arange(len(lengths)), counts)
        out = np.zeros((len(lengths), langs))
        np.add.at(out, text, found.reshape(n, langs))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, whether rejected) of each text."""
        points, lengths = simplify(texts)
        if not self.languages or not len(points):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        symbols = self.symbols(points)
        count = self.phrases(symbols, lengths)
        # A letter that a sample lacks is a phrase, too; it is named among all letters.
        spent = count * (self.bits + LENGTH_BITS) + self.outside(symbols, lengths) * np.log2(self.steps.shape[1])
        cost = spent / np.maximum(lengths, 1)[:, None]
        best = cost.argmin(axis=1)
        rows = np.arange(len(texts))
        least = cost[rows, best]
        if len(self.languages) > 1:
            cost[rows, best] = np.inf
            second = cost.min(axis=1)
            score = np.clip(1 - least / np.maximum(second, 1e-12) / 2, 0, 1)
        else:
            score = np.ones(len(texts))
        empty = lengths == 0
        phrases = count[rows, best]
        strange = (phrases >= FEW_PHRASES) & (lengths < SHORT_PHRASE * phrases)
        names = [UNKNOWN if e else self.languages[b] for b, e in zip(best.tolist(), empty.tolist(), strict=True)]
        return names, np.where(empty, 0.0, score), empty | strange


def samples(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """A bounded sample of labelled texts of each language, whatever their number.

    Of the distinct texts of a language, those with the lowest hash among the ones of at
    most ``chars`` / 8 characters are taken (longer ones only where these do not suffice);
    first within salts, then of the salts' best. Copies count once. Only the taken texts, cut at
    ``chars`` characters each, come to the driver: languages x texts x chars at most.
    """
    rows = docs.filter(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")
    )
    keyed = rows.select(
        "lang", F.xxhash64("text").alias("h"), (F.char_length("text") > chars // 8).alias("long")
    ).groupBy("lang", "h").agg(F.min("long").alias("long"))
    salt = F.pmod(F.shiftright("h", 7), F.lit(SALTS))
    order = [F.col("long"), F.pmod(F.col("h"), F.lit(1 << 40)), F.col("h")]
    inner = Window.partitionBy("lang", salt).orderBy(*order)
    outer = Window.partitionBy("lang").orderBy(*order)
    chosen = (
        keyed.withColumn("n", F.row_number().over(inner)).filter(F.col("n") <= texts)
        .withColumn("n", F.row_number().over(outer)).filter(F.col("n") <= texts)
        .select("lang", "h", "n")
    )
    taken = (
        rows.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, chars).alias("text"))
        .join(F.broadcast(chosen), ["lang", "h"])  # texts rows for each language
        .groupBy("lang", "n").agg(F.min("text").alias("text"))
        .collect()
    )
    out: dict[str, list[tuple[int, str]]] = {}
    for row in taken:
        out.setdefault(row["lang"], []).append((row["n"], row["text"]))
    return {lang: [text for _, text in sorted(x)] for lang, x in out.items()}


def identify(docs: DataFrame, labelled: DataFrame | None = None, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected.

    Learns from ``labelled`` (doc_id, text, lang), by default ``docs``, without the held-out
    part. Null texts and texts without letters are ``und`` with score 0. Texts whose
    phrases are shorter than 1.25 signs on average fit no language; they and ``und`` are
    rejected. With no labelled text all are ``und``. Ties go to the first language by name.
    """
    spark = docs.sparkSession
    sample = samples(docs if labelled is None else labelled, chars=chars)
    model = spark.sparkContext.broadcast(Model.fit(sample, chars))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, scores, rejected = [], [], []
            for _, held in blocks(texts.where(texts.notna(), None)):
                a, b, c = model.value.predict(held)
                names += a
                scores.append(b)
                rejected.append(c)
            yield pd.DataFrame(
                {"lang_pred": names, "score": np.concatenate(scores) if scores else np.zeros(0),
                 "rejected": np.concatenate(rejected) if rejected else np.zeros(0, bool)}
            )

    return docs.withColumn("_found", predict("text")).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")], "_found.*"
    )
