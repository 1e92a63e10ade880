"""Lines that repeat across documents, as compressed keep bitmaps.

Line keys are range partitioned by hash with a secondary sort by document and position,
and each partition is streamed once. A key that spans partitions is settled from the
few runs at partition edges. What leaves is one bitmap for a document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsets.llm.store import saved, shuffle_parts

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


COLUMNS = ("h1", "h2", "d1", "d2", "pos")


class _Stream:
    """One partition's sorted lines: which ones to drop, and which are open.

    The first run of a partition may begin in an earlier one, and the last may go on in
    a later one. Lines of the first run are all open. Other runs hold back their lines
    until they have met ``min_docs`` documents, and drop lines as they come after that;
    so no more than the lines of ``min_docs`` documents are held.
    """

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.key, self.first = None, True
        self.dropped, self.open = [], []

    def begin(self, key) -> None:
        self.first = self.key is None
        self.key, self.held, self.docs, self.last, self.sure = key, [], 0, None, False

    def extend(self, part: list[np.ndarray]) -> None:
        if self.first:
            self.open.append(part)
            return
        if not self.sure:
            changes = (part[2][1:] != part[2][:-1]) | (part[3][1:] != part[3][:-1])
            self.docs += int(changes.sum()) + ((part[2][0], part[3][0]) != self.last)
            self.last = (part[2][-1], part[3][-1])
            self.held.append(part)
            if self.docs >= self.min_docs:
                if self.keep_first:
                    self.held[0] = [c[1:] for c in self.held[0]]
                self.sure, self.held, part = True, [], [np.concatenate(c) for c in zip(*self.held, strict=True)]
            else:
                return
        self.dropped.append(part)

    def add(self, cols: list[np.ndarray]) -> None:
        new = np.ones(len(cols[0]), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(new))
        key = (cols[0][0], cols[1][0])
        if key != self.key:
            self.begin(key)
        self.extend([c[: ends[0]] for c in cols])
        if len(begins) == 1:
            return
        fresh = new.copy()
        fresh[1:] |= (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1])
        many = np.add.reduceat(fresh, begins, dtype=np.int64) >= self.min_docs
        many[0] = many[-1] = False
        if many.any():
            mask = np.repeat(many, ends - begins)
            if self.keep_first:
                mask[begins[many]] = False
            self.dropped.append([c[mask] for c in cols])
        self.begin((cols[0][begins[-1]], cols[1][begins[-1]]))
        self.extend([c[begins[-1] :] for c in cols])

    def end(self) -> None:
        if self.key is not None and not self.first:
            if self.sure:  # tells later partitions; position -1 is no line
                self.open.append([np.array([x], np.int64) for x in (*self.key, 0, 0, -1)])
            else:
                self.open.extend(self.held)

    def take(self) -> Iterator[pa.RecordBatch]:
        for parts, is_open in ((self.dropped, False), (self.open, True)):
            if parts:
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    dict(zip(COLUMNS, cols, strict=True)) | {"is_open": np.full(len(cols[0]), is_open)}
                )
        self.dropped, self.open = [], []


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """(d1, d2, pos) of each line to drop; d1 and d2, doc_id and row number, name a document."""
    lines = docs.select(*_names(), F.posexplode(text_lines(F.col("text"))).alias("pos", "line")).select(
        "d1", "d2", F.col("pos").cast("long").alias("pos"), line_key(F.col("line")).alias("key")
    )
    hashed = lines.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "d1", "d2", "pos"
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(min_docs, keep_first)
        for rows in batches:
            if rows.num_rows:
                state.add([rows[name].to_numpy() for name in COLUMNS])
                yield from state.take()
        state.end()
        yield from state.take()

    marked = saved(
        hashed.repartitionByRange(shuffle_parts(docs), *COLUMNS)
        .sortWithinPartitions(*COLUMNS)
        .mapInArrow(stream, "h1 long, h2 long, d1 long, d2 long, pos long, is_open boolean"),
        "marked_lines",
    )
    edges = marked.filter("is_open")
    # Two keys for each partition at most.
    keys = (
        edges.groupBy("h1", "h2", "d1", "d2").agg(F.min("pos").alias("pos"))
        .groupBy("h1", "h2")
        .agg(
            F.count(F.when(F.col("pos") >= 0, 1)).alias("docs"), (F.min("pos") < 0).alias("sure"),
            F.min(F.when(F.col("pos") >= 0, F.struct("d1", "d2", "pos"))).alias("first"),
        )
        .filter(F.col("sure") | (F.col("docs") >= min_docs))
    )
    late = edges.filter("pos >= 0").join(F.broadcast(keys), ["h1", "h2"])
    if keep_first:
        late = late.filter(F.col("sure") | (F.struct("d1", "d2", "pos") != F.col("first")))
    return marked.filter("not is_open").select("d1", "d2", "pos").unionByName(late.select("d1", "d2", "pos"))


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text), written once, so that each row is a document with one name in all passes."""
    return saved(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")


def _names() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(-1)).cast("long").alias("d1"), F.col("row").alias("d2")]


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """(doc_id, d1, d2, n_lines, n_dropped, keep), one row for each row of ``numbered`` documents.

    Keys of ``min_chars`` code points or more that occur in ``min_docs`` documents or
    more lose their lines: all of them, or with ``keep_first`` all but the first by
    doc_id, row and position. ``keep`` is the zlib-compressed bit string of kept lines, and
    null where nothing is dropped. Null and empty texts have one empty line. Rows that
    are alike are documents of their own, and so are rows without a doc_id. An empty table gives none.
    """
    positions = repeated_lines(docs, min_docs, min_chars, keep_first).groupBy("d1", "d2").agg(F.collect_list("pos").alias("pos"))
    counts = docs.select(
        "doc_id", *_names(), F.size(text_lines(F.col("text"))).cast("long").alias("n_lines")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keeps, dropped = [], []
            lines = rows["n_lines"].to_numpy()
            for at, places in enumerate(rows["pos"]):
                if places.as_py() is None:
                    keeps.append(None)
                    dropped.append(0)
                    continue
                bits = np.ones(lines[at], np.uint8)
                bits[places.values.to_numpy()] = 0
                keeps.append(zlib.compress(np.packbits(bits).tobytes()))
                dropped.append(int(lines[at] - bits.sum()))
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], rows["d1"], rows["d2"], rows["n_lines"], pa.array(dropped, pa.int64()), pa.array(keeps, pa.binary())],
                ["doc_id", "d1", "d2", "n_lines", "n_dropped", "keep"],
            )

    return counts.join(positions, ["d1", "d2"], "left").select("doc_id", "d1", "d2", "n_lines", "pos").mapInArrow(
        pack, "doc_id long, d1 long, d2 long, n_lines long, n_dropped long, keep binary"
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each document's kept lines, joined by line feeds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = []
            for text, keep in zip(rows["text"], rows["keep"], strict=True):
                value, bits = text.as_py() or "", keep.as_py()
                if bits is not None:
                    lines = value.split("\n")
                    kept = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
                    value = "\n".join(line for line, k in zip(lines, kept.tolist(), strict=True) if k)
                texts.append(value)
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], rows["n_lines"], rows["n_dropped"], pa.array(texts, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "text"],
            )

    rows = docs.select(*_names(), "text").join(bitmaps, ["d1", "d2"])
    return rows.select("doc_id", "n_lines", "n_dropped", "text", "keep").mapInArrow(
        cut, "doc_id long, n_lines long, n_dropped long, text string"
    )
