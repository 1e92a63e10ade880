"""Token ids as length-delimited binary records with a separate offset index.

A record file holds, for each document in order of doc_id: the payload's length as an
unsigned 64-bit number, that length's masked CRC-32C, the payload and its masked CRC-32C,
all little-endian; this is the TFRecord frame. The payload is the ids as unsigned numbers
of 2 bytes, or of 4 if the vocabulary needs them; the manifest says which. The index beside
it holds one entry of fixed width for each record, so readers can fetch records in any order.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsets.llm.store import saved, scratch_path, shuffle_parts

END_ID = 1
ENTRY = np.dtype([("has_id", "<u8"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("start", "<u8")])
FRAME = 16  # bytes around a payload
READ_BYTES = 1 << 20  # framing takes some 25 times as much for a moment
CACHED_WORDS = 250_000  # about 50 MB a worker
SEGMENT = 128  # words of 4 bytes in a segment; checksums of all segments advance side by side
_POLY = np.uint32(0x82F63B78)


@cache
def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a state's lower and upper half become after 4 zero bytes, and after a segment of them."""
    low = np.arange(65536, dtype=np.uint32)
    halves = [low.copy(), low << np.uint32(16)]
    for half in halves:
        for _ in range(32):
            half[:] = (half >> np.uint32(1)) ^ (_POLY * (half & np.uint32(1)))
    far = [low.copy(), low << np.uint32(16)]
    for half in far:
        for _ in range(SEGMENT):
            half[:] = halves[0][half & np.uint32(0xFFFF)] ^ halves[1][half >> np.uint32(16)]
    return halves[0], halves[1], far[0], far[1]


def _before_ones() -> np.ndarray:
    """The 4 bytes, as units, that turn a zero state into all ones."""
    state = 0xFFFFFFFF
    for _ in range(32):
        state = (((state ^ int(_POLY)) << 1) | 1) if state >> 31 else state << 1
    return np.array([state & 0xFFFF, state >> 16], np.uint16)


def crc32c(units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of each run of 2-byte units; runs follow each other.

    The initial state, all ones, comes from 4 bytes in front, and zeros before these
    leave a zero state; so runs are filled up in front to whole segments.
    """
    low, high, far_low, far_high = _crc_tables()
    if not len(lengths):
        return np.zeros(0, np.uint32)
    segments = -(-(lengths + 2) // (2 * SEGMENT))
    ends = np.cumsum(segments) * 2 * SEGMENT
    starts = np.cumsum(lengths) - lengths
    grid = np.zeros(int(ends[-1]), "<u2")
    grid[np.arange(len(units)) + np.repeat(ends - lengths - starts, lengths)] = units
    first_units = _before_ones()
    grid[ends - lengths - 2], grid[ends - lengths - 1] = first_units[0], first_units[1]
    columns = np.ascontiguousarray(grid.view("<u4").reshape(-1, SEGMENT).T)
    state = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        state ^= column
        state = low[state & np.uint32(0xFFFF)] ^ high[state >> np.uint32(16)]
    first = np.cumsum(segments) - segments
    total = state[first]
    for step in range(1, int(segments.max())):
        more = np.flatnonzero(segments > step)
        before = total[more]
        total[more] = far_low[before & np.uint32(0xFFFF)] ^ far_high[before >> np.uint32(16)] ^ state[first[more] + step]
    return total ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that a checksum of data that holds checksums stays good."""
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def _heads(sizes: np.ndarray) -> np.ndarray:
    return sizes.astype("<u8").view("<u2")


def frame(units: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The records of payloads of ``counts`` 2-byte units each, and the size of each record."""
    heads = _heads(counts * 2)
    head_crc = masked(crc32c(heads, np.full(len(counts), 4))).view("<u2").reshape(-1, 2)
    body_crc = masked(crc32c(units, counts)).view("<u2").reshape(-1, 2)
    ends = np.cumsum(counts + FRAME // 2)
    begins = ends - counts - FRAME // 2
    out = np.empty(int(ends[-1]) if len(ends) else 0, "<u2")
    for k in range(4):
        out[begins + k] = heads[k::4]
    for k in range(2):
        out[begins + 4 + k] = head_crc[:, k]
        out[ends - 2 + k] = body_crc[:, k]
    out[np.arange(len(units)) + np.repeat(begins + 6 - (np.cumsum(counts) - counts), counts)] = units
    return out.tobytes(), counts * 2 + FRAME


def unframe(data: bytes, entries: np.ndarray) -> list[np.ndarray]:
    """The payloads of records that lie one after another; fails on any false length or checksum."""
    units = np.frombuffer(data, "<u2")
    counts = (entries["length"].astype(np.int64) - FRAME) // 2
    ends = np.cumsum(counts + FRAME // 2)
    begins = ends - counts - FRAME // 2
    marks = np.concatenate([begins[:, None] + np.arange(6), ends[:, None] + np.arange(-2, 0)], axis=1)
    inside = np.ones(len(units), bool)
    inside[marks.ravel()] = False
    payload, heads = units[inside], units[marks[:, :4]].ravel()
    head_crc = np.ascontiguousarray(units[marks[:, 4:6]]).view("<u4").ravel()
    body_crc = np.ascontiguousarray(units[marks[:, 6:]]).view("<u4").ravel()
    if (
        (heads != _heads(counts * 2)).any()
        or (head_crc != masked(crc32c(heads, np.full(len(counts), 4)))).any()
        or (body_crc != masked(crc32c(payload, counts))).any()
    ):
        raise ValueError("a record's length or checksum is false")
    return np.split(payload, np.cumsum(counts)[:-1])


class _Words(dict):
    """Ids of words as bytes, encoded when first met.

    Half the bound are the newest words, half those before; of the latter, words that are
    not met again are forgotten.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.before = {}

    def __missing__(self, word: str) -> bytes:
        out = self.before.get(word)
        if out is None:
            out = self.encode(word)
        if len(self) >= CACHED_WORDS // 2:
            self.before = dict(self)
            self.clear()
        self[word] = out
        return out

    def forget(self) -> None:
        self.before = {}
        self.clear()


class Encoder:
    """Token ids of texts with a tokenizer that drops white space.

    Such a tokenizer never joins signs across white space, so each stretch between
    white space is encoded once and remembered. Words of Latin letters are cut by the
    tokenizer's own rule and go to its model directly, all others through its encode().
    Texts or lines of such words alone are lower-cased and get a blank behind each run of
    letters that a sign follows, where the rule cuts anyway: "Word" and "word," are one word then.
    """

    RULE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    SIGNS = "!-~\xa1-\xac\xae-\u012f\u2010-\u2027\u2030-\u205e\u20ac"  # NFC leaves them alone
    LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f"  # those of SIGNS, in lower case
    LATIN = re.compile(f"[{SIGNS}]+")
    BLANKS = "\t-\r \x85\xa0"
    LATIN_TEXT = re.compile(f"[{BLANKS}{SIGNS}]*")
    BEHIND = re.compile(f"[^{BLANKS}{LETTERS}](?<=[{LETTERS}].)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.signs = self._byte_signs()
        self.words = _Words(self._word)
        probe = "The quick-brown fox's 12 jumps, don't!! it'll (a_b) x=3.5 we'reals Élan NAÏVE çà½²ß\u0301 Œ"
        line = "\u201cThe fox\u2019s\u201d dén,x's''T we'RE-12½ ªb2,c\u2026 "
        self.latin = True
        self.latin = all(self._by_rule(w) == self._whole(w) for w in probe.split()) and self.encode(line)[: -self.dtype.itemsize] == self._whole(line)
        self.words.forget()

    def _byte_signs(self) -> list[str]:
        """The sign that stands for each byte: printing Latin-1 signs for themselves, others from U+0100 on."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        out = {byte: chr(byte) for byte in own}
        for number, byte in enumerate(b for b in range(256) if b not in out):
            out[byte] = chr(0x100 + number)
        return [out[byte] for byte in range(256)]

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join([self.signs[b] for b in piece.encode()])
        return self._bytes([t.id for t in self.model.tokenize(text)])

    def _by_rule(self, word: str) -> bytes:
        plain = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
        pieces = [plain] if plain.isalpha() else self.RULE.findall(plain)
        if pieces == [word]:
            return self._piece(word)
        return b"".join(map(self.words.__getitem__, pieces))

    def _word(self, word: str) -> bytes:
        if self.latin and word.isascii() and word.isalpha() and word.islower():
            return self._piece(word)
        if self.latin and self.LATIN.fullmatch(word) and "<|" not in word:
            return self._by_rule(word)
        return self._whole(word)

    def _cut(self, text: str) -> str | None:
        if self.latin and self.LATIN_TEXT.fullmatch(text) and "<|" not in text:
            return self.BEHIND.sub(r" \g<0>", text.lower())
        return None

    def encode(self, text: str) -> bytes:
        """The ids of a whole text and the end id, as bytes of ``dtype``."""
        end = self._bytes([END_ID])
        cut = self._cut(text)
        if cut is None:
            if re.search("[\x1c-\x1f]", text):  # white space for split() only
                return self._whole(text) + end
            cut = "\n".join([self._cut(line) or line for line in text.split("\n")])
        return b"".join(map(self.words.__getitem__, cut.split())) + end


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes record and index files of ``docs`` (doc_id, text); returns their manifest.

    Documents are dealt into ranges of doc_id (null first, equal ids by text), each range
    goes to one file, and files are numbered in that order. Null texts are empty and have
    the end id only. The manifest has one row for each file that a finished task wrote:
    part, data, index, id_bytes, n_docs, n_tokens, and before (ids in earlier files). Files of lost
    or repeated tasks have other names and are in no manifest. No rows give no files.
    """
    spark = docs.sparkSession
    folder = (folder or scratch_path(spark, "records")).rstrip("/")
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
        tool = encoder(tokenizer)
        data = index = None
        offset = tokens = n_docs = 0
        for rows in batches:
            texts, keys = rows["text"], rows["doc_id"]
            at = 0
            while at < rows.num_rows:
                ids, size, begin = [], 0, at
                while at < rows.num_rows and size < READ_BYTES:
                    ids.append(tool.encode(texts[at].as_py() or ""))
                    size += len(ids[-1])
                    at += 1
                if data is None:
                    data, index = files.open_output_stream(f"{name}.rec"), files.open_output_stream(f"{name}.idx")
                sizes = np.array([len(x) for x in ids], np.int64)
                counts = sizes // tool.dtype.itemsize
                raw, lengths = frame(np.frombuffer(b"".join(ids), "<u2"), sizes // 2)
                entries = np.zeros(len(sizes), ENTRY)
                held = keys.slice(begin, at - begin)
                entries["has_id"] = held.is_valid().to_numpy(zero_copy_only=False)
                entries["doc_id"] = held.fill_null(0).to_numpy()
                entries["length"] = lengths
                entries["offset"] = offset + np.cumsum(lengths) - lengths
                entries["start"] = tokens + np.cumsum(counts) - counts
                data.write(raw)
                index.write(entries.tobytes())
                offset, tokens, n_docs = offset + len(raw), tokens + int(counts.sum()), n_docs + len(sizes)
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "data": [f"{os.path.basename(name)}.rec"], "index": [f"{os.path.basename(name)}.idx"],
                 "id_bytes": [tool.dtype.itemsize], "n_docs": [n_docs], "n_tokens": [tokens]}
            )

    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
    written = saved(
        ordered.repartitionByRange(shuffle_parts(docs), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
        .mapInArrow(write, "part long, data string, index string, id_bytes long, n_docs long, n_tokens long"),
        "manifest",
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return written.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).withColumn("folder", F.lit(folder))


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record of a manifest, each checked.

    ``ids`` are unsigned 32-bit little-endian numbers, as bytes; ``start`` counts the ids of all records before.
    Files are read in pieces of bounded size (or one longer record).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                files, base = _filesystem(row["folder"])
                with files.open_input_stream(f"{base}/{row['index']}") as index, files.open_input_stream(f"{base}/{row['data']}") as data:
                    entries = np.frombuffer(index.read(), ENTRY)
                    piece = np.cumsum(entries["length"].astype(np.int64)) // READ_BYTES
                    for held in np.split(entries, np.flatnonzero(np.diff(piece)) + 1):
                        ids = [_numbers(x, row["id_bytes"]) for x in unframe(data.read(int(held["length"].sum())), held)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(held["doc_id"], pa.int64(), mask=held["has_id"] == 0),
                                pa.array(held["start"].astype(np.int64) + row["before"]),
                                pa.array([len(x) for x in ids], pa.int64()),
                                pa.array([x.tobytes() for x in ids], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    files = max(1, min(shuffle_parts(manifest), manifest.count()))
    return manifest.repartition(files, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def fetch_records(manifest_rows: list[dict], keys: list[tuple[int, int]]) -> list[np.ndarray]:
    """Ids of single records by (file number in the list, record number), through the index."""
    out = []
    for file, number in keys:
        row = manifest_rows[file]
        files, base = _filesystem(row["folder"])
        with files.open_input_file(f"{base}/{row['index']}") as index, files.open_input_file(f"{base}/{row['data']}") as data:
            entry = np.frombuffer(index.read_at(ENTRY.itemsize, number * ENTRY.itemsize), ENTRY)
            out.append(_numbers(unframe(data.read_at(int(entry["length"][0]), int(entry["offset"][0])), entry)[0], row["id_bytes"]))
    return out


def _numbers(units: np.ndarray, id_bytes: int) -> np.ndarray:
    return units.view("<u2" if id_bytes == 2 else "<u4").astype("<u4")


def session_tokenizer(spark: SparkSession | None = None) -> str:
    """The vocabulary file's path; it is a parameter of every call and part of no repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
