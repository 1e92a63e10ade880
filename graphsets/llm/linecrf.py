"""Quality rules by line labels: a linear-chain conditional random field.

Each line of a text is content or boilerplate. A line has one value of each feature
(length, letters, signs, repeats, place); weights of the values and of neighbouring labels
are fitted to labelled documents by maximum likelihood, and the Viterbi path labels the
lines of every whole text. The share of words in content lines decides what is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.llm.codes import mix, run_hashes
from graphsets.llm.langid import held_out


SAMPLE_DOCS = 3_000  # labelled documents of each class; with the next two the bound of the fit
SAMPLE_CHUNKS = 6_000  # of each class
CHUNK = 64  # lines of a training sequence
ROUNDS, STEPS, RATE, PENALTY = 3, 150, 0.1, 1e-3
SHARE = 0.5  # of words in content lines
MIN_WORDS, MAX_REPEATED = 50, 50  # per cent
SALTS = 64
BLOCK_CHARS = 2_000_000
SYMBOLS = b"#*$%&|<>"
BOILERPLATE, CONTENT = 0, 1

# Upper ends of a feature's values; a value beyond the last is one more.
CUTS = {
    "words": (0, 2, 5, 10, 20, 50, 200),
    "word_length": (2.5, 4, 5.5, 7, 10),
    "upper": (0, 0.02, 0.06, 0.2, 0.5),
    "digits": (0, 0.05, 0.2),
    "symbols": (0, 0.05, 0.3),
    "punctuation": (0, 0.1, 0.3, 0.6, 1.2),
    "repeated": (0, 0.1, 0.3, 0.6),
    "duplicate": (0,),
    "sentence_end": (0,),
    "capital_start": (0,),
    "place": (0, 1),  # first, inner, last
}
SIZES = [len(c) + 1 for c in CUTS.values()]
FIRST = np.cumsum([0, *SIZES[:-1]])
N_VALUES = sum(SIZES)


@cache
def _classes() -> dict[str, np.ndarray]:
    """For each byte whether it belongs to a class."""
    code = np.arange(256)
    ascii_letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    digit = (code >= 48) & (code <= 57)
    symbol = np.isin(code, list(SYMBOLS))
    return {
        "point": (code & 0xC0) != 0x80,
        "upper": (code >= 65) & (code <= 90),
        "letter": ascii_letter | (code >= 0xC0),
        "digit": digit,
        "symbol": symbol,
        "punctuation": (code > 32) & (code < 127) & ~ascii_letter & ~digit & ~symbol,
        "space": np.isin(code, [0x20, *range(0x09, 0x0E)]),
    }


class Lines:
    """Counts of some texts, and the values of the features of their lines."""

    def __init__(self, texts: list[str]):
        raw = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        kind = _classes()
        self.n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.n_lines)
        self.first_line = np.cumsum(self.n_lines) - self.n_lines
        feeds = np.flatnonzero(raw == 10)
        begin, end = np.append(0, feeds + 1), np.append(feeds, len(raw))
        if len(begin) > len(self.doc):  # no texts at all
            begin, end = begin[:0], end[:0]
        solid = ~kind["space"][raw]

        def per_line(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return sums[end] - sums[begin]

        at = np.flatnonzero(solid)
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > 1
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(at)))
        line_of = np.searchsorted(begin, at[start], "right") - 1
        doc_of = self.doc[line_of]
        words = np.bincount(line_of, minlength=len(begin))
        chars = per_line(solid & kind["point"][raw])
        counted = {name: per_line(kind[name][raw]) for name in ("upper", "letter", "digit", "symbol", "punctuation")}

        covered = self._repeats(run_hashes(raw[at], start, sizes), doc_of)
        repeats = np.bincount(line_of, weights=covered, minlength=len(begin)).astype(np.int64)
        duplicate = self._duplicates(raw, begin, end, words > 0)

        def per_doc(values: np.ndarray) -> np.ndarray:
            return np.bincount(self.doc, weights=values, minlength=len(texts)).astype(np.int64)

        self.line_words = words
        self.n_words, self.word_chars, self.n_symbols = per_doc(words), per_doc(chars), per_doc(counted["symbol"])
        self.n_dup_lines, self.n_repeat_words = per_doc(duplicate), per_doc(repeats)

        last = np.zeros(len(begin), np.uint8)
        lead = last.copy()
        some = words > 0
        word_first = np.flatnonzero(np.append(True, np.diff(line_of) > 0)) if len(line_of) else line_of
        word_last = np.append(word_first[1:], len(line_of)) - 1
        if len(line_of):
            lead[some] = raw[at[start[word_first]]]
            last[some] = raw[at[start[word_last] + sizes[word_last] - 1]]
        n, c, letters = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(counted["letter"], 1)
        place = np.ones(len(begin), np.int64)
        place[self.first_line + self.n_lines - 1] = 2
        place[self.first_line] = 0
        columns = {
            "words": words, "word_length": counted["letter"] / n, "upper": counted["upper"] / letters, "digits": counted["digit"] / c,
            "symbols": counted["symbol"] / n, "punctuation": counted["punctuation"] / n, "repeated": repeats / n, "duplicate": duplicate,
            "sentence_end": np.isin(last, list(b".?!")), "capital_start": ((lead >= 65) & (lead <= 90)) | (lead >= 0xC0), "place": place,
        }
        self.values = np.stack(
            [first + np.searchsorted(cuts, columns[name].astype(np.float64), "left") for (name, cuts), first in zip(CUTS.items(), FIRST, strict=True)],
            axis=1,
        ).astype(np.int16)

    @staticmethod
    def _repeats(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which words lie in windows of three that their text has twice."""
        covered = np.zeros(len(hashes), bool)
        if len(hashes) < 3:
            return covered
        with np.errstate(over="ignore"):
            key = mix(mix(mix(doc[2:].astype(np.uint64)) + hashes[:-2]) * np.uint64(3) + hashes[1:-1]) * np.uint64(5) + hashes[2:]
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        _, number, counts = np.unique(key[inside], return_inverse=True, return_counts=True)
        twice = inside[counts[number] > 1]
        for step in range(3):
            covered[twice + step] = True
        return covered

    def _duplicates(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, has_word: np.ndarray) -> np.ndarray:
        """Which lines with a word equal an earlier line of their text."""
        out = np.zeros(len(begin), bool)
        some = np.flatnonzero(has_word)
        if len(some) < 2:
            return out
        sizes = (end - begin)[some]
        flat = np.repeat(begin[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        hashes = run_hashes(raw[flat], np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            key = mix(hashes + mix(self.doc[some].astype(np.uint64)))
        _, first = np.unique(key, return_index=True)
        out[some] = True
        out[some[first]] = False
        return out


def _scores(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    return weights[values.astype(np.int64)].sum(axis=1)


def viterbi(unary: np.ndarray, links: np.ndarray) -> list[int]:
    """The likeliest labels of one sequence: ``unary`` is what content has ahead of boilerplate on each line."""
    (bb, bc), (cb, cc) = links.tolist()
    back: list[tuple[int, int]] = []
    lost, held = 0.0, None
    for value in unary.tolist():
        if held is None:
            held = value
            continue
        to_b = (lost + bb, 0) if lost + bb >= held + cb else (held + cb, 1)
        to_c = (lost + bc, 0) if lost + bc > held + cc else (held + cc, 1)
        back.append((to_b[1], to_c[1]))
        lost, held = to_b[0], to_c[0] + value
    label = int(held >= lost)
    out = [label]
    for pointers in reversed(back):
        label = pointers[label]
        out.append(label)
    return out[::-1]


def marginals(unary: np.ndarray, mask: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of content, expected pairs of labels, sum of log normalisers) of padded sequences."""
    n, length = unary.shape
    scores = np.stack([np.zeros_like(unary), unary], axis=2)
    ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    ahead[:, 0] = scores[:, 0]
    for t in range(1, length):
        step = np.logaddexp(ahead[:, t - 1, :1] + links[0], ahead[:, t - 1, 1:] + links[1]) + scores[:, t]
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        after = behind[:, t + 1] + scores[:, t + 1]
        step = np.logaddexp(after[:, :1] + links[:, 0], after[:, 1:] + links[:, 1])
        behind[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * mask
    pairs = np.zeros((2, 2))
    inner = mask[:, 1:]
    for a in range(2):
        for b in range(2):
            value = ahead[:, :-1, a] + links[a, b] + scores[:, 1:, b] + behind[:, 1:, b] - total[:, None]
            pairs[a, b] = np.exp(np.where(inner, value, -np.inf)).sum()
    return content, pairs, float(total.sum())


def fit(chunks: Sequence[np.ndarray], labels: Sequence[np.ndarray], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the values for content, weights of neighbouring labels) of highest penalised likelihood."""
    length = max(len(c) for c in chunks)
    values = np.zeros((len(chunks), length, len(CUTS)), np.int64)
    truth, mask = np.zeros((len(chunks), length)), np.zeros((len(chunks), length), bool)
    for i, (chunk, label) in enumerate(zip(chunks, labels, strict=True)):
        values[i, : len(chunk)], truth[i, : len(chunk)], mask[i, : len(chunk)] = chunk, label, True
    flat = values[mask]
    inner = mask[:, 1:]
    was, now = truth[:, :-1][inner].astype(int), truth[:, 1:][inner].astype(int)
    seen_pairs = np.bincount(was * 2 + now, minlength=4).reshape(2, 2)
    seen = np.bincount(flat.ravel(), weights=np.repeat(truth[mask], flat.shape[1]), minlength=N_VALUES)
    weights = np.zeros(N_VALUES + 4)
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    n = mask.sum()
    for step in range(1, steps + 1):
        unary = np.where(mask, weights[values].sum(axis=2), 0.0)
        content, pairs, _ = marginals(unary, mask, weights[N_VALUES:].reshape(2, 2))
        expected = np.bincount(flat.ravel(), weights=np.repeat(content[mask], flat.shape[1]), minlength=N_VALUES)
        slope = np.concatenate([seen - expected, (seen_pairs - pairs).ravel()]) / n - PENALTY * weights
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        weights = weights + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return weights[:N_VALUES], weights[N_VALUES:].reshape(2, 2)


def _blocks(column) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for at, text in enumerate(column):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= BLOCK_CHARS:
            yield first, held
            first, held, size = at + 1, [], 0
    if held:
        yield first, held


def _lowest(rows: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` rows of each class, those of the lowest hash ``h``."""
    for group in (["good", F.pmod("h", F.lit(SALTS))], ["good"]):
        window = Window.partitionBy(*group).orderBy("h", "id")
        rows = rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= keep)
    return rows.drop("_n")


def training_chunks(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, good, h, values, words): feature values of runs of ``CHUNK`` lines of labelled documents not held out.

    A document with several labels is bad if one says so.
    """
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") >= 1).alias("good")).withColumn("h", F.xxhash64("id"))
    )
    chosen = _lowest(known, sample_docs).select("id", "good")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, good = rows["id"].to_numpy(), rows["good"].to_numpy(zero_copy_only=False)
            for start, texts in _blocks(rows["text"]):
                lines = Lines(texts)
                for at, (first, n) in enumerate(zip(lines.first_line.tolist(), lines.n_lines.tolist(), strict=True)):
                    for begin in range(first, first + n, CHUNK):
                        stop = min(begin + CHUNK, first + n)
                        yield pa.RecordBatch.from_pydict({
                            "id": [int(ids[start + at])], "good": [bool(good[start + at])], "chunk": [begin - first],
                            "values": [lines.values[begin:stop].tobytes()], "words": [lines.line_words[begin:stop].astype(np.int64).tobytes()],
                        })

    named = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")  # 2 x sample_docs rows
    rows = named.select("id", "good", "text").mapInArrow(cut, "id long, good boolean, chunk long, values binary, words binary")
    return rows.withColumn("h", F.xxhash64("id", "chunk", "values"))


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS):
    """The fitted model, or None without labels of both classes.

    Lines first have the label of their document. Then good lines of bad documents, such as
    a sentence above a table, become content where the model says so, as long as less
    than half of the words do. The first model looks at each line alone, as labels of
    documents make all neighbours alike.
    """
    rows = _lowest(training_chunks(docs, labels, sample_docs), SAMPLE_CHUNKS).select("good", "h", "id", "values", "words").collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["id"], r["values"]))
    if len({r["good"] for r in rows}) < 2:
        return None
    chunks = [np.frombuffer(r["values"], np.int16).reshape(-1, len(CUTS)) for r in rows]
    words = [np.frombuffer(r["words"], np.int64) for r in rows]
    truth = [np.full(len(c), int(r["good"])) for c, r in zip(chunks, rows, strict=True)]
    for number in range(rounds):
        alone = number == 0
        flat = (np.concatenate(chunks)[:, None], np.concatenate(truth)[:, None])
        model = fit(*flat) if alone else fit(chunks, truth)
        for i, row in enumerate(rows):
            if not row["good"]:
                ahead = _scores(model[0], chunks[i])
                said = (ahead > 0).astype(int) if alone else np.array(viterbi(ahead, model[1]))
                truth[i] = said if 2 * words[i][said == CONTENT].sum() < words[i].sum() else np.zeros(len(said), int)
    return fit(chunks, truth)


def _labelled(texts: list[str], model) -> list[pa.Array]:
    """The counts of some texts and the labels of their lines."""
    lines = Lines(texts)
    content = np.ones(len(lines.doc), bool)
    if model is not None:
        unary = _scores(model[0], lines.values)
        for first, n in zip(lines.first_line.tolist(), lines.n_lines.tolist(), strict=True):
            content[first : first + n] = viterbi(unary[first : first + n], model[1])
    held = np.bincount(lines.doc, weights=lines.line_words * content, minlength=len(texts)).astype(np.int64)
    counts = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, held]
    ends = pa.array(np.append(0, np.cumsum(lines.n_lines)), pa.int32())
    return [*map(pa.array, counts), pa.ListArray.from_arrays(ends, pa.array(content))]


def label_lines(docs: DataFrame, model) -> DataFrame:
    """``docs`` with the counts of each whole text, the label of each line and the verdict.

    Added are n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (under 50 words, or more than half of them in repeated windows of three), is_content
    (for each line), content_words and kept; columns of these names are replaced. Null and
    empty texts have one line without words, and fail. Without a model all lines are content.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")

    @F.arrow_udf(", ".join(f"{name} long" for name in longs) + ", is_content array<boolean>")
    def label(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for column in parts:
            found = [_labelled(texts, model) for _, texts in _blocks(column)]
            whole = [pa.concat_arrays(c) for c in zip(*found, strict=True)]
            yield pa.StructArray.from_arrays(whole, [*longs, "is_content"])

    failed: Column = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    others = [c for c in docs.columns if c not in (*longs, "is_content", "base_failed", "kept", "_lines")]
    return (
        docs.withColumn("_lines", label("text")).select(*[F.col(f"`{c}`") for c in others], "_lines.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("content_words") >= SHARE * F.col("n_words")))
    )


def judge(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``label_lines`` with a model learned from ``labels`` (doc_id, quality)."""
    return label_lines(docs, learn(docs, labels, sample_docs))
