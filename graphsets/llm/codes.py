"""Texts as arrays of code points, words and word windows, for numpy inside tasks.

A word is a maximal run of letters and digits; words compare in lower case. Null
texts count as empty. Work is cut into blocks of bounded size, so a task holds one
block of texts (or one longer text) beside its Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

LIMIT = 0x110000  # all code points
LETTERS_END = 0x40000  # no letters, digits or white space from here on
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
BLOCK_CHARS = 400_000
# Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, lower, upper) by code point; lower keeps signs whose lower case is longer."""
    kind = np.zeros(LIMIT, np.uint8)
    lower = np.arange(LIMIT, dtype=np.uint32)
    upper = np.zeros(LIMIT, bool)
    for point in range(LETTERS_END):
        sign = chr(point)
        if sign.isalpha():
            kind[point] = LETTER
            small = sign.lower()
            if len(small) == 1 and small != sign:
                lower[point], upper[point] = ord(small), True
        elif sign.isdigit():
            kind[point] = DIGIT
        elif sign.isspace():
            kind[point] = SPACE
    return kind, lower, upper


@cache
def unspaced() -> np.ndarray:
    """Which code points belong to scripts that set no blanks between words."""
    out = np.zeros(LIMIT, bool)
    for first, last in UNSPACED:
        out[first : last + 1] = True
    return out


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text begins (with the end)."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, "<u4").astype(np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def blocks(texts: Iterable[str | None], size: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) in blocks of about ``size`` characters."""
    first, held, chars = 0, [], 0
    for at, text in enumerate(texts):
        held.append(text or "")
        chars += len(held[-1])
        if chars >= size:
            yield first, held
            first, held, chars = at + 1, [], 0
    if held:
        yield first, held


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * _M1
        values = (values ^ (values >> np.uint64(27))) * _M2
    return values ^ (values >> np.uint64(31))


@cache
def _powers(size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(size, _BASE, np.uint64))


def powers(size: int) -> np.ndarray:
    return _powers(1 << max(8, int(size - 1).bit_length()))


def run_sums(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A polynomial of each run of ``points``; runs follow each other without gaps.

    That of two runs in a row is the first one's plus the second one's times
    ``powers`` [length of the first - 1].
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    inside = np.arange(len(points)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        terms = (points.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[inside]
        return np.add.reduceat(terms, starts)


def run_hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of ``points``; runs follow each other without gaps."""
    sums = run_sums(points, starts, lengths)
    with np.errstate(over="ignore"):
        return mix(sums + lengths.astype(np.uint64))


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word, in order."""
    kind, lower, _ = tables()
    kinds = kind[points]
    at = np.flatnonzero((kinds == LETTER) | (kinds == DIGIT))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(text) > 0)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(at)))
    return text[starts], run_hashes(lower[points[at]], starts, lengths)


def windows(text: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, hash) of each window of ``width`` words.

    A text of fewer words, but one at least, has one window of all its words.
    """
    if not len(text):
        return text, np.zeros(0, np.int64), hashes
    new = np.ones(len(text), bool)
    new[1:] = text[1:] != text[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(text)))
    with np.errstate(over="ignore"):
        whole = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1 :]) if len(text) >= width else np.zeros(0, np.int64)
        total = np.zeros(len(whole), np.uint64)
        for step in range(width):
            total = total * _M1 + hashes[whole + step]
        few = np.flatnonzero(lengths < width)
        short = np.zeros(len(few), np.uint64)
        for step in range(width - 1):
            has = lengths[few] > step
            short[has] = short[has] * _M1 + hashes[starts[few][has] + step]
        short += lengths[few].astype(np.uint64) * _M2
    first = np.concatenate([whole, starts[few]])
    found = mix(np.concatenate([total, short]))
    order = np.argsort(first, kind="stable")
    return text[first[order]], first[order], found[order]
