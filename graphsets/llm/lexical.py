"""Ranked lexical search, a term at a time with limited accumulators.

The terms of an item are taken from the rarest to the most frequent. While a document
that holds none of the terms so far could still reach the k-th partial score, each
posting makes an accumulator; as soon as the remaining bounds fall below that score,
only documents that have one are updated, exactly and to the last term. Documents lie
in shards of bounded size, and a task carries each item's k best from shard to shard,
so later shards start with the level that earlier ones have reached.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphsets.llm.prefix import running_sums
from graphsets.llm.store import saved

BLOCK_TERMS = 500_000  # terms of the items that are looked for in one pass over the documents
SHARD_DOCS, SHARD_POSTINGS = 32_768, 4_000_000
PIECE_BYTES = 1 << 20
SALTS = 64
LAST = np.iinfo(np.int64).max

# ASCII letters (in lower case), digits and all bytes of other signs stay; the rest parts terms.
_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in _KEPT)


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term of a whole text, as UTF-8; a null text has none.

    All signs that part terms are ASCII, so terms can be cut from the encoded text. Long
    texts are counted piece by piece.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    found: Counter = Counter()
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + PIECE_BYTES) if len(raw) - start > PIECE_BYTES else -1
        stop = len(raw) if stop < 0 else stop
        found.update(raw[start:stop].split())
        start = stop
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): the distinct terms of each row of items; rows are items of their own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            terms = [sorted(term_counts(text)) for text in rows["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows["item_id"], pa.array(terms, pa.list_(pa.binary())), pa.array([len(t) for t in terms], pa.int64())],
                ["item_id", "terms", "n_terms"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    named = items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, terms array<binary>, n_terms long")
    return saved(named.filter("n_terms > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def _postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs): length and looked for terms of each document that has terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for rows in batches:
            lengths, terms, tfs, ends = [], [], [], [0]
            for text in rows["text"]:
                found = term_counts(text.as_py())
                lengths.append(found.total())
                held = [(numbers[term], tf) for term, tf in found.items() if term in numbers]
                terms.append(np.array([t for t, _ in held], np.int32))
                tfs.append(np.array([tf for _, tf in held], np.int64))
                ends.append(ends[-1] + len(held))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], pa.array(lengths, pa.int64())]
                + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in zip(flat, (pa.int32(), pa.int64()), strict=True)],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>").filter("n > 0")


class Shard:
    """Posting lists of some documents: for each term who holds it and what it adds to the score."""

    def __init__(self, ids, missing, terms, owners, adds):
        self.ids, self.missing = ids, missing
        order = np.argsort(terms, kind="stable")
        self.owners, self.adds = owners[order], adds[order]
        self.terms, self.begin = np.unique(terms[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))
        self.most = np.maximum.reduceat(self.adds, self.begin) if len(order) else self.adds

    def search(self, wanted: np.ndarray, k: int, level: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, accumulators made) of all that may be among the k best; ``wanted`` by rising frequency.

        ``level`` is a score that k documents have reached elsewhere, 0 if none.
        """
        at = np.searchsorted(self.terms, wanted)
        at = np.minimum(at, len(self.terms) - 1)
        at = at[self.terms[at] == wanted] if len(self.terms) else at[:0]
        rest = np.cumsum(self.most[at][::-1])[::-1]
        score = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids), bool)
        creating = True
        for place, limit in zip(at.tolist(), rest.tolist(), strict=True):
            owners, adds = (x[self.begin[place] : self.end[place]] for x in (self.owners, self.adds))
            # Equal scores may still win by doc_id, so only a lower bound stops.
            creating = creating and limit >= level
            if creating:
                score[owners] += adds
                seen[owners] = True
                if len(score) >= k:
                    level = max(level, int(np.partition(score, len(score) - k)[len(score) - k]))
            else:
                known = seen[owners]
                score[owners[known]] += adds[known]
        found = np.flatnonzero(seen & (score > 0) & (score >= level))
        return found, score[found], int(seen.sum())


class Best:
    """The k best documents of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        none = np.zeros(0, np.int64)
        self.held = [(none, none.astype(bool), none)] * n_items

    def level(self, item: int) -> int:
        score = self.held[item][2]
        return int(score[-1]) if len(score) >= self.k else 0

    def add(self, item: int, ids, missing, score) -> None:
        ids, missing, score = (np.concatenate(x) for x in zip(self.held[item], (ids, missing, score), strict=True))
        first = np.lexsort((ids, missing, -score))[: self.k]
        self.held[item] = ids[first], missing[first], score[first]


def _searched(index: DataFrame, wanted, weights, totals: tuple[int, int], k: int, shard_docs: int) -> DataFrame:
    """(item, doc_id, score): the k best of each task for each item."""
    n_docs, n_terms = totals

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = wanted.value, weights.value
        best = Best(len(items), k)
        held: list[tuple] = []

        def settle() -> None:
            sizes = np.concatenate([h[2] for h in held])
            n, terms, tfs = (np.concatenate([h[c] for h in held]) for c in (3, 4, 5))
            ids, missing = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            held.clear()
            owners = np.repeat(np.arange(len(ids)), sizes)
            m = 50 + (50 * n * n_docs) // n_terms
            adds = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[owners]))
            shard = Shard(ids, missing, terms, owners, adds)
            for item, terms_of in enumerate(items):
                found, score, _ = shard.search(terms_of, k, best.level(item))
                best.add(item, ids[found], missing[found], score)

        for rows in batches:
            missing = rows["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = rows["doc_id"].fill_null(LAST).to_numpy()
            n, terms, tfs = rows["n"].to_numpy(), rows["terms"], rows["tfs"]
            ends = terms.offsets.to_numpy().astype(np.int64)
            flat_terms, flat_tfs = terms.values.to_numpy(), tfs.values.to_numpy()
            start = 0
            while start < len(ids):
                room = shard_docs - sum(len(h[0]) for h in held)
                space = SHARD_POSTINGS - sum(len(h[4]) for h in held)
                stop = min(len(ids), start + room, max(start + 1, int(np.searchsorted(ends, ends[start] + space, "right")) - 1))
                a, b = ends[start], ends[stop]
                held.append((ids[start:stop], missing[start:stop], np.diff(ends[start : stop + 1]), n[start:stop], flat_terms[a:b], flat_tfs[a:b]))
                if stop < len(ids) or stop - start == room or b - a >= space:
                    settle()
                start = stop
        if held:
            settle()
        for item, (ids, missing, score) in enumerate(best.held):
            yield pa.RecordBatch.from_pydict(
                {"number": pa.array(np.full(len(ids), item)), "doc_id": pa.array(ids, mask=missing), "score": pa.array(score)}
            )

    return index.select("doc_id", "n", "terms", "tfs").mapInArrow(search, "number long, doc_id long, score long")


def search_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, integer BM25.

    A term weighs floor(1000 ln((2N + 2) / (2df + 1))); the score sums weight times the
    saturated frequency, in 64-bit integers. Equal scores go by rising doc_id, null last;
    rows that are alike rank side by side. Null and empty texts have no term, and items
    without terms, or whose terms nobody holds, give no rows; nor does an empty table.
    Items are taken in blocks of about ``block_terms`` terms, each of which is one pass
    over the documents; an item is in one block.
    """
    spark = docs.sparkSession
    asked = saved(running_sums(item_terms(items), ["item"], {"before": "n_terms"}), "asked")
    last = asked.agg(F.max("before")).first()[0]
    found = []
    for block in range(0 if last is None else last // block_terms + 1):
        rows = asked.filter(F.expr(f"before div {block_terms}L") == block).select("item", "item_id", "terms")
        of_block = rows.collect()  # block_terms terms, and those of one item more, at most
        if not of_block:
            continue
        number = {term: i for i, term in enumerate(sorted({bytes(t) for row in of_block for t in row["terms"]}))}
        index = saved(_postings(docs, spark.sparkContext.broadcast(number)), "postings")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        frequency = np.zeros(len(number), np.int64)
        counts = index.select(F.explode("terms").alias("term")).groupBy("term").count()
        for row in counts.toLocalIterator():  # as many rows as the block has terms
            frequency[row["term"]] = row["count"]
        weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
        wanted = []
        for row in of_block:
            terms = np.array([number[bytes(t)] for t in row["terms"]], np.int64)
            wanted.append(terms[np.lexsort((terms, frequency[terms]))])
        sent = [spark.sparkContext.broadcast(x) for x in (wanted, weight)]
        best = _searched(index, *sent, (n_docs, n_terms), k, shard_docs)
        names = spark.createDataFrame([(i, row["item"]) for i, row in enumerate(of_block)], "number long, item long")
        found.append(best.join(F.broadcast(names), "number").join(F.broadcast(rows.select("item", "item_id")), "item"))
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = reduce(DataFrame.unionByName, found).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for group in (["item", "_salt"], ["item"]):  # k rows of each task
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
