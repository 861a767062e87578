"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text is turned into :data:`FEATURES` transformed statistics. Every class gets a mean and a
covariance shrunk towards the pooled covariance and a multiple of the identity; its Cholesky factor
is computed once and sent with the scoring tasks. The score is the logistic function of the
difference of the two Gaussian log densities (log determinant plus Mahalanobis distance) and the
log prior odds.

Null texts count as empty texts; texts of any length are read whole. Equal texts get equal scores, and repeated
rows and ids stay as they are. A column named ``quality_score`` is replaced; other columns are kept, whatever their
names. An empty table gives an empty result. Without labels of both classes the model is undecided and every
score is 1.0, so nothing is rejected unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, labelled, small_batches, tidy

#: What each component of a feature vector measures.
FEATURES = (
    "log words", "log mean word length", "spread of word lengths", "share of upper case", "share of symbols", "share of digits",
    "log distinct words per log words", "share of words that end in a symbol", "share of symbol-only words", "share of repeated lines",
    "share of repeated word pairs", "log mean line length", "character entropy",
)
#: Labelled rows that a fit uses at most.
MAX_LABELLED = 20_000
#: Shares of pooled covariance and of scaled identity in each class covariance.
TO_POOLED, TO_IDENTITY = 0.2, 0.02
#: Lines added to the denominators of the repetition shares, so that one repeat in a short text weighs little.
DAMPING = 8
#: A log-odds difference of so much counts as a factor e.
TEMPERATURE = 4.0
#: Score from which a document counts as good.
THRESHOLD = 0.7

_OTHER, _UPPER, _LETTER, _DIGIT, _SPACE = range(5)
_LAST = 0x20000
_classes: np.ndarray | None = None


def _char_classes() -> np.ndarray:
    """The class of each code point of the first two planes, and of the third's first, a letter, for all beyond."""
    global _classes
    if _classes is None:
        chars = map(chr, range(_LAST + 1))
        _classes = np.array(
            [_UPPER if c.isupper() else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else _OTHER for c in chars],
            dtype=np.uint8,
        )
    return _classes


def text_features(text: str | None) -> np.ndarray:
    """The statistics of one whole text, in the order of :data:`FEATURES`."""
    text = text or ""
    out = np.zeros(len(FEATURES))
    words = text.split()
    if not words:
        return out
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _LAST)
    other, upper, letters, digits, _ = np.bincount(_char_classes()[points], minlength=5)
    seen = max(1, other + upper + letters + digits)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = np.bincount(points & 1023)
    share = counts[counts > 0] / len(points)
    ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words)
    loud = sum(w.endswith(("!!", "??")) for w in words)
    bare = sum(len(w) == 1 and not w.isalnum() for w in words)
    out[:] = (
        np.log1p(len(words)), np.log(lengths.mean()), np.log1p(lengths.std()), np.sqrt(upper / seen), np.sqrt(other / seen), np.sqrt(digits / seen),
        np.log1p(len(set(words))) / np.log1p(len(words)), np.sqrt((ends + loud) / len(words)), np.sqrt(bare / len(words)), np.sqrt((len(lines) - len(set(lines))) / (len(lines) + DAMPING)),
        np.sqrt((len(words) - 1 - len(set(zip(words, words[1:], strict=False)))) / (len(words) + 8 * DAMPING)),
        np.log1p(len(text) / len(lines)), -(share * np.log(share)).sum(),
    )
    return out


@dataclass(frozen=True)
class Moments:
    """Count, sum and sum of outer products of the feature vectors of a class."""

    n: float
    total: np.ndarray
    outer: np.ndarray


@dataclass(frozen=True)
class QualityModel:
    """Means, inverse Cholesky factors and log terms of the two classes; ``None`` fields: undecided."""

    means: tuple[np.ndarray, np.ndarray] | None = None
    whiten: tuple[np.ndarray, np.ndarray] | None = None
    offset: tuple[float, float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores in 0 to 1 of the rows of ``x``."""
        if self.means is None:
            return np.ones(len(x))
        logs = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offset, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPERATURE, -500, 500)))


def model_from(moments: dict[int, Moments]) -> QualityModel:
    """The discriminant of two classes; every class needs at least two rows."""
    if any(y not in moments or moments[y].n < 2 for y in (0, 1)):
        return QualityModel()
    n, d = sum(m.n for m in moments.values()), len(moments[0].total)
    means = {y: m.total / m.n for y, m in moments.items()}
    scatter = {y: m.outer - m.n * np.outer(means[y], means[y]) for y, m in moments.items()}
    pooled = sum(scatter.values()) / n
    whiten, offset = [], []
    for y in (0, 1):
        own = scatter[y] / moments[y].n
        cov = (1 - TO_POOLED) * own + TO_POOLED * pooled
        cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * np.diag(np.diag(pooled) + 1e-6)
        chol = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(chol))
        offset.append(float(np.log(moments[y].n / n) - np.log(np.diag(chol)).sum()))
    return QualityModel((means[0], means[1]), (whiten[0], whiten[1]), (offset[0], offset[1]))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Fits on the documents of at most ``max_labelled`` labelled rows outside the held-out fold.

    The label rows are broadcast: ``max_labelled`` rows of 16 bytes. Each task makes one set of moments
    per class; Spark adds them up, and the driver gets one set per class."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y"), strict=True):
                x = text_features(text.as_py())
                m = sums.setdefault(y.as_py(), [0.0, np.zeros(len(x)), np.zeros((len(x), len(x)))])
                m[0] += 1
                m[1] += x
                m[2] += np.outer(x, x)
        if sums:
            rows = [(y, n, t.tolist(), o.ravel().tolist()) for y, (n, t, o) in sums.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)],
                ["y", "n", "total", "outer"],
            )

    sample = labelled(labels, "quality", 4, 2, max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "y")
    parts = rows.mapInArrow(moments, "y int, n double, total array<double>, outer array<double>")
    parts = parts.select("y", F.posexplode(F.concat(F.array("n"), "total", "outer")).alias("at", "x")).groupBy("y", "at").agg(F.sum("x").alias("x"))
    sums: dict[int, dict[int, float]] = {}
    with small_batches(docs.sparkSession):
        found = parts.collect()  # numbers of two classes
    for r in found:
        sums.setdefault(r.y, {})[r["at"]] = r.x
    d = len(FEATURES)
    flat = {y: np.array([x[k] for k in range(1 + d + d * d)]) for y, x in sums.items()}
    return model_from({y: Moments(x[0], x[1 : 1 + d], x[1 + d :].reshape(d, d)) for y, x in flat.items()})


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Every row and column of ``docs`` with its ``quality_score`` (replacing a column of that name)."""
    docs = docs.drop("quality_score")
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([text_features(t.as_py()) for t in batch.column(at)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(tidy(scored), T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def classify_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 4 is 2), score, predicted (score of :data:`THRESHOLD` or more)."""
    model = fit_quality(docs, labels, max_labelled)
    rows = score_quality(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        (id_crc("doc_id") % 4 == 2).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose score is at least ``threshold``."""
    rows = score_quality(docs, fit_quality(docs, labels))
    return rows.where(F.col("quality_score") >= threshold).select(*docs.columns)
