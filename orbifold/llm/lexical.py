"""Ranked lexical search: postings are scored in windows of documents, with scores and occupancy in cache-sized arrays.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A to Z are lower-cased. A first
pass over the documents stores for each its length and the occurrences of the terms that any item asks for; Spark sums
up the number of documents, their terms and each term's document frequency. In the second pass a task numbers the
documents it holds in their order and traverses the postings in windows of :data:`WINDOW` numbers: for each item the
contributions of its terms are added into an array over the window, a bitset notes which places they reach, and the
places noted are harvested into the item's heap of the k best. Ranks of all tasks meet in two steps, so that no task
gets more than a share of an item's rows.

Items are ranked in blocks of :data:`BLOCK_BYTES` of their texts (a longer item is a block by itself), which bounds the
terms that tasks are sent; each block passes over the documents once.

Null texts and texts without terms count in no statistic and are never ranked, as are items without terms. Items with a
null id take no part; of rows that repeat an item's id the least text asks. Repeated documents are ranked each; a
document's null id comes after all others among equal scores. Texts are read whole, in pieces of :data:`PIECE` bytes cut
between terms. Scores beyond 64 bits are not met: a term adds less than 10^6 times its weight. Empty tables give an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, tidy

#: Documents of a window: its scores take 128 KB.
WINDOW = 16_384
#: Bytes of the texts of a block of items, and of a piece of a document.
BLOCK_BYTES, PIECE = 4 << 20, 4 << 20
#: Groups that an item's rows are ranked in before all meet.
SALTS = 32
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def occurrences(text: bytes) -> Counter[bytes]:
    """How often each term occurs in a text."""
    found: Counter[bytes] = Counter()
    for some in pieces(text):
        found.update(some)
    return found


def weight(documents: int, df: int) -> int:
    """The weight of a term that ``df`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Items:
    """A block of items: ids, and for each the numbers of its terms and their occurrences."""

    ids: list[int]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        items = cls([], [], [], vocabulary)
        for item, text in sorted(rows):
            found = occurrences((text or "").encode())
            if found:
                items.ids.append(item)
                items.terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in found], np.int64))
                items.times.append(np.array(list(found.values()), np.int64))
        return items


def postings(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the rows (doc_id, text in UTF-8) that hold a term: its number of terms, and the numbers and
    occurrences of those in ``vocabulary``."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = occurrences(text.as_py() or b"")
                if found:
                    own = [(vocabulary[t], c) for t, c in found.items() if t in vocabulary] if len(found) < len(vocabulary) else [(k, found[t]) for t, k in vocabulary.items() if t in found]
                    ids.append(doc_id)
                    lengths.append(found.total())
                    terms.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return texts.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


class Windows:
    """Scores and occupancy of one window of documents, used for one window and item after another."""

    def __init__(self) -> None:
        self.scores = np.zeros(WINDOW, np.int64)
        self.occupied = np.zeros(WINDOW // 64, np.uint64)

    def load(self, term: np.ndarray, place: np.ndarray, score: np.ndarray, terms: int) -> None:
        """Takes the postings of a window: each term's places in order, and for its bits the words of the bitset it reaches."""
        order = np.argsort(term * WINDOW + place, kind="stable")
        term, self.place, self.score = term[order], place[order], score[order]
        self.at = np.searchsorted(term, np.arange(terms + 1))
        word = term * (WINDOW // 64) + self.place // 64
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        self.word = word[first] % (WINDOW // 64)
        self.bits = np.bitwise_or.reduceat(np.uint64(1) << (self.place % 64).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
        self.bits_at = np.searchsorted(term[first], np.arange(terms + 1))

    def of_item(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that the terms reach and their scores; the arrays are clear again afterwards."""
        for t, n in zip(terms.tolist(), times.tolist(), strict=True):
            a, b = self.at[t], self.at[t + 1]
            if a < b:
                self.scores[self.place[a:b]] += self.score[a:b] * n if n > 1 else self.score[a:b]
                a, b = self.bits_at[t], self.bits_at[t + 1]
                self.occupied[self.word[a:b]] |= self.bits[a:b]
        found = np.flatnonzero(np.unpackbits(self.occupied.view(np.uint8), bitorder="little"))
        scores = self.scores[found]
        self.scores[found] = 0
        self.occupied[:] = 0
        return found, scores


def contributions(term: np.ndarray, tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What postings add to the score of their documents; ``m`` is that of each posting's document."""
    return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def ranked(batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, documents: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    """(item_id, doc_id, score) of the k best documents (doc_id, n, terms, tfs) of a task for each item."""
    best: list[list[tuple[int, int, int]]] = [[] for _ in items.ids]  # heaps of (score, not null, -doc_id): the first is the k-th
    windows = Windows()

    def score(rows: pa.Table) -> None:
        ids, terms, tfs = rows["doc_id"].combine_chunks(), rows["terms"].combine_chunks(), rows["tfs"].combine_chunks()
        place = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
        m = np.array([75 + 25 * n * documents // total for n in rows["n"].to_pylist()], np.int64)
        term = terms.flatten().to_numpy().astype(np.int64)
        windows.load(term, place, contributions(term, tfs.flatten().to_numpy().astype(np.int64), m[place], weights), len(weights))
        known, doc_id = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for heap, own, times in zip(best, items.terms, items.times, strict=True):
            found, scores = windows.of_item(own, times)
            least = heap[0][0] if len(heap) == k else 1
            at = np.flatnonzero(scores >= least)
            if len(at) > k:
                at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
            if len(at) > k:  # equal scores: smaller ids first, null last
                at = at[np.lexsort((doc_id[found[at]], ~known[found[at]], -scores[at]))[:k]]
            for p, s in zip(found[at].tolist(), scores[at].tolist(), strict=True):
                entry = (s, int(known[p]), -int(doc_id[p]))
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, WINDOW - held)
            waiting.append(some)
            held += some.num_rows
            batch = batch.slice(some.num_rows)
            if held == WINDOW:
                score(pa.Table.from_batches(waiting))
                waiting, held = [], 0
    if waiting:
        score(pa.Table.from_batches(waiting))
    columns = [[i for i, heap in zip(items.ids, best, strict=True) for _ in heap], [-d if known else None for heap in best for _, known, d in heap], [s for heap in best for s, _, _ in heap]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])


def _ranked_block(spark: SparkSession, texts: DataFrame, items: Items, k: int) -> DataFrame:
    held = Stored(postings(texts, items.vocabulary), "postings")
    documents, total = held.df.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.vocabulary), np.int64)  # as many as the block's terms
    for r in held.df.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r.term] = r["count"]
    weights = np.array([weight(documents, int(d)) for d in df], np.int64)
    sent = spark.sparkContext.broadcast((items, weights))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from ranked(batches, *sent.value, documents, total, k)

    found = held.df.mapInArrow(run, "item_id long, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*best))).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best))
    out = Stored(some.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
    held.discard()
    sent.destroy()
    return out.df


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = -(-size // BLOCK_BYTES)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    out = None
    for block in range(blocks):
        own = Items.of([(r.item_id, r.text) for r in asked.where(F.col("block") == block).collect()])
        if own.ids:
            found = _ranked_block(spark, texts, own, k)
            out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
