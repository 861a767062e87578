"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only documents are labelled.

A sentence's probability is logistic in the distinct words it holds and their stems (leading letters), and 0 where it
holds none that has a weight, so that no number of clean sentences makes a document toxic. A document is toxic unless
all its sentences are clean, so its score is the noisy-or ``1 - prod(1 - p)``. Weights are trained on document labels
through that formula, for words and stems that toxic documents hold significantly more often. The sentences' own
probabilities then locate what offends.

Null texts count as empty; they and texts without words score 0. Texts of any length are read whole. Equal texts get
equal scores, and repeated rows and ids stay as they are; a labelled id is trained on one of its texts. An empty table
gives an empty result; without training labels of both classes every score is 0. Columns named like the outputs are
replaced; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, labelled

#: Labelled rows that a fit uses at most.
MAX_LABELLED = 8_000
#: Leading letters that count as stems of longer words.
STEMS = (4, 5, 6)
#: A word or stem needs so many toxic documents and standard errors above clean ones to be considered.
LEAST_DOCS, LEAST_Z = 3, 3.0
STEPS, RATE = 200, 0.15
#: A word gets a weight only where it explains the loss of more toxic documents than this.
EXPLAINS = 0.3
THRESHOLD = 0.5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of the sentences of a text that hold words."""
    found = []
    for m in _SENTENCE.finditer(text or ""):
        words = set(_WORD.findall(m.group().lower()))
        if words:
            found.append((m.start(), m.end(), words))
    return found


def word_ids(word: str) -> list[int]:
    """Hashes of a word and its stems."""
    parts = [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) >> 1 for p in parts]


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by word hash and the bias of a sentence; no bias: nothing was learnt."""

    bias: float | None = None
    weights: dict[int, float] = field(default_factory=dict)

    def sentence_logits(self, bag: list[set[str]], known: dict[str, float | None]) -> list[float]:
        """Logits of sentences, -inf for those without a weight; ``known`` caches the weights of words."""
        if len(known) > 500_000:
            known.clear()
        out = []
        for words in bag:
            found = []
            for w in words:
                if w not in known:
                    own = [self.weights[k] for k in word_ids(w) if k in self.weights]
                    known[w] = sum(own) if own else None
                if known[w] is not None:
                    found.append(known[w])
            out.append(self.bias + sum(found) if found else -math.inf)
        return out


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - p) of sentence logits."""
    return -math.expm1(-sum(max(s, 0.0) + math.log1p(math.exp(-abs(s))) for s in logits))


def train(bags: list[list[np.ndarray]], others: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """Weights from documents (each a list of word-id arrays, one per sentence that has any, and the number of its
    other sentences, of which the bias alone is learnt) and their labels.

    Adam on the mean log loss of the noisy-or; a proximal step after each
    update sets small weights to zero."""
    sents = [s for bag in bags for s in bag]
    if not (y == 1).any() or not (y == 0).any() or not sents:
        return ToxicityModel()
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    ids = np.concatenate(sents)
    sent = np.repeat(np.arange(len(sents)), [len(s) for s in sents])
    vocabulary, column = np.unique(ids, return_inverse=True)
    share = 1 / len(y)
    penalty = EXPLAINS * share
    w, b = np.zeros(len(vocabulary)), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        s = b + np.bincount(sent, w[column], len(sents))
        a = np.bincount(doc, np.logaddexp(0, s), len(bags)) + others * np.logaddexp(0, b)
        outer = np.where(y == 1, -1 / np.expm1(np.clip(a, 1e-9, 500)), 1.0) * share
        g = outer[doc] / (1 + np.exp(-np.clip(s, -500, 500)))
        grad = np.append(np.bincount(column, g[sent], len(w)), g.sum() + (outer * others).sum() / (1 + np.exp(-b)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        scale = RATE / (np.sqrt(v[:-1] / (1 - 0.999**step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale * penalty, 1.0), 0.0)
    used = np.flatnonzero(w)
    return ToxicityModel(float(b), dict(zip(vocabulary[used].tolist(), w[used].tolist(), strict=True)))


def telling_features(rows: DataFrame) -> np.ndarray:
    """Ids of words and stems that toxic documents of ``rows`` (text, y) hold significantly more often than clean ones.

    Tasks count documents per id, shuffles add the counts up; only ids that pass reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lru_cache(200_000)(word_ids)
        for batch in batches:
            held: dict[int, list[np.ndarray]] = {0: [], 1: []}
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                found = {k for _, _, words in sentences(text.as_py()) for w in words for k in ids(w)}
                held[y.as_py()].append(np.fromiter(found, np.int64, len(found)))
            for y, parts in held.items():
                if parts:
                    k, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n if y else n * 0), pa.array(n * 0 if y else n)], ["k", "toxic", "clean"])

    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return np.empty(0, np.int64)
    counts = rows.select("text", "y").mapInArrow(count, "k long, toxic long, clean long").groupBy("k").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p = (F.col("toxic") + F.col("clean") + 1) / (n1 + n0 + 2)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return np.array(sorted(r.k for r in counts.where((F.col("toxic") >= LEAST_DOCS) & (z >= LEAST_Z)).select("k").collect()), np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fits on the documents of at most ``max_labelled`` labelled rows outside the held-out fold.

    The label rows are broadcast (16 bytes each); the driver gets the telling words of those documents' sentences.
    Of rows that share a labelled id one text is taken, so repeated ids add nothing to what the driver gets."""
    sample = labelled(labels, "toxic", 5, 0, max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    wanted = telling_features(rows)
    telling = frozenset(wanted.tolist())

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lru_cache(200_000)(lambda w: [k for k in word_ids(w) if k in telling])
        for batch in batches:
            found = [[[k for w in words for k in ids(w)] for _, _, words in sentences(t.as_py())] for t in batch.column(0)]
            full = [[s for s in bag if s] for bag in found]
            others = [max(1, len(a)) - len(b) for a, b in zip(found, full, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(others, pa.int64()), pa.array(full, pa.list_(pa.list_(pa.int64())))], ["y", "others", "bag"])

    found = rows.select("text", "y").mapInArrow(bags, "y int, others long, bag array<array<long>>").toArrow()
    return train([[np.array(s, np.int64) for s in bag] for bag in found["bag"].to_pylist()], found["others"].to_numpy(), found["y"].to_numpy().astype(np.int64))


def score_toxicity(docs: DataFrame, model: ToxicityModel, locate: bool = False) -> DataFrame:
    """Every row and column of ``docs`` with ``toxicity`` and, to ``locate`` them, ``offending``:
    array<struct<start, end, score>> of the sentences of score :data:`THRESHOLD` or more."""
    docs = docs.drop("toxicity", "offending")
    at = docs.columns.index("text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores, found = [], []
            for text in batch.column(at):
                parts = sentences(text.as_py()) if model.bias is not None else []
                logits = model.sentence_logits([p[2] for p in parts], known)
                scores.append(noisy_or([s for s in logits if s > -math.inf]))
                if locate:
                    found.append([{"start": p[0], "end": p[1], "score": noisy_or([s])} for p, s in zip(parts, logits, strict=True) if s >= 0])
            arrays, names = [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "toxicity"]
            if locate:
                arrays, names = [*arrays, pa.array(found, span)], [*names, "offending"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = [*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]
    if locate:
        kind = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
        fields.append(T.StructField("offending", T.ArrayType(kind)))
    return docs.mapInArrow(scored, T.StructType(fields))


def classify_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 5 is 0), score, predicted (score of :data:`THRESHOLD` or more) and the
    offending sentences (start, end and score of each)."""
    model = fit_toxicity(docs, labels, max_labelled)
    rows = score_toxicity(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, locate=True)
    return rows.select(
        "doc_id",
        (id_crc("doc_id") % 5 == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
        "offending",
    )
