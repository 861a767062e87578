"""Packing documents into sequences: cutting-stock column generation over a length histogram.

A document is its token ids and an end token. Documents longer than a sequence are cut into full sequences
and a remainder; every remainder (and shorter document) falls into one of :data:`CLASSES` classes of length,
rounded up. Filling sequences with these at least cost is the cutting-stock problem: a linear program over
patterns (how many pieces of each class a sequence takes), whose columns are priced by an unbounded knapsack
solved by dynamic programming, all of an evaluation's improving ones at once and between the present prices and the best
so far. It ends within :data:`GAP` of its own lower bound, after whatever number of columns that takes. Further columns
cut a piece of one class into pieces of two others, at the price of :data:`CUT` sequences each, which matters where lengths
do not fit together. Counts are rounded down and what is left is packed first-fit decreasing. Pieces are ranked within
their class, and a rank's cut, pattern, sequence and slot are arithmetic.

The histogram (at most :data:`CLASSES` numbers) is all that reaches the driver; the program is solved in a task. A class
is ranked in as many parts as it has multiples of :data:`RANK_ROWS` pieces, so none is sorted in one task; rows are dealt
to these by numbers of their own, so equal rows spread. A piece comes with the running checksums at the places where it
may be cut, from which those of its parts follow without its ids.

Texts are encoded as the tokenizer is loaded, so the strings of its added tokens become those tokens. Null texts count
as empty and give the end token alone. Texts of any length are encoded whole. Rows with null or repeated ids and repeated
rows are packed like any other; equal ones tie in any order. Other columns are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_task, stored, tidy

SEQUENCE = 4096
CLASSES = 256
END_ID = 2
#: Pieces of a class that are ranked together.
RANK_ROWS = 500_000
#: Characters that are encoded together.
RUN_CHARS = 500_000
#: Column generation ends within this share of the least possible number of sequences.
GAP = 2e-4
#: Sequences that a cut has to save.
CUT = 1 / 64


class WordIds(dict):
    """Token ids of texts, by a table of the ids of their white-space separated pieces.

    The tokenizer drops white space and lets no token span it, so the ids of a text are those of its pieces.
    Only the characters that every definition of white space holds are cut at. A piece is a core and simple
    punctuation after it, if the tokenizer always splits between them: not after letters that it takes apart into
    letters and marks, which is tried out for each letter. New cores of Latin letters are encoded
    together in one call and told apart by the end-of-word tokens; others one by one. As a mapping, it gives
    the number of a piece in the table; unseen ones get the next."""

    SIMPLE = ".,;:!?*#%$&"
    KEPT = 500_000

    def __init__(self, tokenizer_path: str, kept: int = KEPT) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {t[0] for t in self.added}
        self.plain_marks = not any(m.isalnum() or m in self.SIMPLE for m in self.marks)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.tails: dict[str, np.ndarray] = {}
        self.closed: dict[str, bool] = {}
        self.kept = kept
        self.new: list[str] = []
        self.flat, self.start, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.times = np.empty(0, np.int64)

    def _forget(self) -> None:
        """Drops the pieces that came once, and the rarest of the others where they are more than half of what is kept.

        What stays counts half as often, so that pieces that no longer come go in their turn."""
        stay = np.flatnonzero(self.times > 1)
        if len(stay) > self.kept // 2:
            stay = np.sort(stay[np.argsort(-self.times[stay], kind="stable")[: self.kept // 2]])
        flags = np.zeros(len(self), bool)
        flags[stay] = True
        pieces = [piece for piece, stays in zip(self, flags.tolist(), strict=True) if stays]
        self.clear()
        self.update(zip(pieces, range(len(pieces)), strict=True))
        self.flat, self.length = strung(self.flat, self.start[stay], self.length[stay]), self.length[stay]
        self.start = np.cumsum(self.length) - self.length
        self.times = self.times[stay] // 2

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        self.new.append(piece)
        return k

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cores(self, cores: list[str]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
        """The ``cores`` in another order, their ids one after another, and how many each has."""
        latin = [c for c in cores if c.isalpha() and c.isascii()] + [c for c in cores if not c.isascii() and c.isalpha() and max(c) <= "\xff"]
        ids = self._alone([" ".join(latin)])[0]
        lengths = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        if len(lengths) != len(latin):
            latin, ids, lengths = [], ids[:0], lengths[:0]
        known = set(latin)
        rest = [c for c in cores if c not in known]
        apart = self._alone(rest)
        return latin + rest, [ids, *apart], np.append(lengths, np.fromiter(map(len, apart), np.int64, len(apart)))

    def _closes(self, letter: str) -> bool:
        """Whether the tokenizer splits between a letter or digit and punctuation."""
        if letter.isascii() or letter in self.closed:
            return letter.isascii() or self.closed[letter]
        alone, mark, both = self._alone([letter, self.SIMPLE[0], letter + self.SIMPLE[0]])
        self.closed[letter] = np.array_equal(np.append(alone, mark), both)
        return self.closed[letter]

    def _part(self, piece: str) -> tuple[str, str]:
        """Core and tail of a piece."""
        core = piece.rstrip(self.SIMPLE)
        if core and len(core) < len(piece) and core[-1].isalnum() and not self._closes(core[-1]):
            return piece, ""
        plain = self.plain_marks and core.isalnum()  # so it holds no mark
        if not plain:
            plain = core and core[-1].isalnum()
            if plain and any(m in piece for m in self.marks):  # added tokens are told by their case
                plain = not any(t in piece.lower() for t in self.added)
            if not plain:
                return piece, ""
        return core.lower() if core.isascii() else core, piece[len(core) :]

    def _parts(self) -> list[tuple[str, str]]:
        """Core and tail of each new piece."""
        out, simple, plain, closed = [], self.SIMPLE, self.plain_marks, self.closed
        for piece in self.new:
            core = piece.rstrip(simple)
            if plain and core.isascii() and core.isalnum():  # what most are, told without a call
                out.append((core.lower(), piece[len(core) :]))
            elif plain and core.isalnum() and (len(core) == len(piece) or core[-1].isascii() or closed.get(core[-1])):
                out.append((core, piece[len(core) :]))
            else:
                out.append(self._part(piece))
        return out

    def _learn(self) -> None:
        parts, learned = self._parts(), len(self.length)
        unlike = dict.fromkeys(c for c, _ in parts)
        at = [self.get(c, learned) for c in unlike]  # a core that is a known piece itself is not encoded again
        known = [c for c, k in zip(unlike, at, strict=True) if k < learned]
        old = np.array([k for k in at if k < learned], np.int64)
        cores, ids, lengths = self._cores([c for c, k in zip(unlike, at, strict=True) if k >= learned])
        ends = list(dict.fromkeys(t for _, t in parts))
        unseen = [t for t in ends if t not in self.tails]
        self.tails |= dict(zip(unseen, self._alone(unseen), strict=True))
        ids = np.concatenate([*ids, strung(self.flat, self.start[old], self.length[old]), *(self.tails[t] for t in ends)])
        lengths = np.concatenate([lengths, self.length[old], [len(self.tails[t]) for t in ends]]).astype(np.int64)
        cores = cores + known
        core, end = ({x: k for k, x in enumerate(xs)} for xs in (cores, ends))
        numbers = np.array([(core[c], end[t]) for c, t in parts], np.int64).reshape(-1, 2) + [0, len(cores)]
        starts = np.cumsum(lengths) - lengths
        of = lengths[numbers].sum(axis=1)
        self.start = np.append(self.start, len(self.flat) + np.cumsum(of) - of)
        self.length = np.append(self.length, of)
        self.flat = np.append(self.flat, strung(ids, starts[numbers.ravel()], lengths[numbers.ravel()]))
        self.new = []
        if len(self.tails) > 10_000:
            self.tails.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self) > self.kept:
            self._forget()
        pieces = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        numbers = [np.fromiter(map(self.__getitem__, p), np.int64, len(p)) for p in pieces]
        if self.new:
            self._learn()
        times = np.bincount(np.concatenate(numbers), minlength=len(self)) if numbers else np.zeros(len(self), np.int64)
        times[: len(self.times)] += self.times
        self.times = times
        return [strung(self.flat, self.start[k], self.length[k]) for k in numbers]


@lru_cache(maxsize=1)
def word_ids(tokenizer_path: str, kept: int) -> WordIds:
    """The table of this process, which later tasks in it go on with."""
    return WordIds(tokenizer_path, kept)


def strung(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with these starts and lengths, one after another."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, keep_ids: bool = False, kept: int = WordIds.KEPT, classes: int = CLASSES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], crcs) of the full sequences and remainders of ``docs``;
    ``crcs`` are a remainder's checksums up to each multiple of a class's width."""
    unit = -(-sequence // classes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path, kept) if kept >= WordIds.KEPT else WordIds(tokenizer_path, kept)
        for batch in batches:
            out: list[list] = [[] for _ in names]

            def flush(out: list[list] = out) -> pa.RecordBatch:
                arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
                for c in out:
                    c.clear()
                return pa.RecordBatch.from_arrays(arrays, names)

            for doc_id, ids in encoded(words, batch):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), sequence):
                    piece = ids[start : start + sequence]
                    crc, crcs = checksums(piece, unit if len(piece) < sequence else sequence)
                    values = [doc_id.as_py(), start, len(piece), crc, len(ids), *([piece.tolist()] if keep_ids else []), crcs]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                if keep_ids and len(out[0]) > 500:
                    yield flush()
            yield flush()

    def encoded(words: WordIds, batch: pa.RecordBatch) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
        run, size = [], 0
        for k, text in enumerate(batch.column(1)):
            run.append(text.as_py() or "")
            size += len(run[-1])
            if size >= RUN_CHARS or k + 1 == batch.num_rows:
                first = k + 1 - len(run)
                yield from zip(batch.column(0)[first : k + 1], words.encode(run), strict=True)
                run, size = [], 0

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids, "crcs"]
    kinds = [*(pa.int64(),) * 5, *[pa.list_(pa.int32())] * keep_ids, pa.binary()]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids array<int>, " * keep_ids + "crcs binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(cut), schema)


def checksums(ids: np.ndarray, unit: int) -> tuple[int, bytes]:
    """The checksum of ids, and those of their beginnings of ``unit`` ids, twice as many, and so on, one after another."""
    data, crc, crcs = memoryview(ids.tobytes()), 0, []
    for at in range(0, len(data), 4 * unit):
        crc = zlib.crc32(data[at : at + 4 * unit], crc)
        crcs.append(crc)
    return crc, np.array(crcs[:-1], "<u4").tobytes()


def later_checksum(whole: int, before: int, n: int) -> int:
    """The checksum of the last ``n`` ids, from those of all and of the ids before."""
    zeros = bytes(4 * n)
    return whole ^ zlib.crc32(zeros, before) ^ zlib.crc32(zeros)


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most valuable multiset of items (sizes ascending) for each capacity up to this: values and patterns."""
    value, pattern = np.zeros(capacity + 1), np.zeros((capacity + 1, len(sizes)), np.int64)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(sizes, c, side="right")
        value[c], pattern[c] = value[c - 1], pattern[c - 1]
        if fits:
            worth = prices[:fits] + value[c - sizes[:fits]]
            k = int(worth.argmax())
            if worth[k] > value[c]:
                value[c], pattern[c] = worth[k], pattern[c - sizes[k]]
                pattern[c, k] += 1
    return value, pattern


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits, by dynamic programming over the capacity."""
    value, pattern = knapsack(prices, sizes, capacity)
    return float(value[-1]), pattern[-1]


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and counts that take every piece, each filled with the largest pieces that fit and are left."""
    left, chosen = demand.astype(np.int64).copy(), []
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in np.argsort(-sizes):
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        taken = pattern > 0
        times = int((left[taken] // pattern[taken]).min())
        chosen.append((pattern, times))
        left -= times * pattern
    return chosen


class Cuts:
    """The columns that cut a piece in two: one of a class less, one more of each of two others."""

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, cutting: bool) -> None:
        at = {int(s): k for k, s in enumerate(sizes)}
        found = [(at[s], at[a], at[s - a]) for s in (sizes[demand > 0].tolist() if cutting else []) for a in range(1, s // 2 + 1) if a in at and s - a in at]
        self.whole, self.first, self.rest = np.array(found, np.int64).reshape(-1, 3).T

    def gains(self, prices: np.ndarray) -> np.ndarray:
        return prices[self.whole] - prices[self.first] - prices[self.rest] - CUT

    def column(self, k: int, n: int) -> np.ndarray:
        out = np.zeros(n)
        out[self.whole[k]] += 1
        out[self.first[k]] -= 1
        out[self.rest[k]] -= 1
        return out


def fractional_packing(sizes: np.ndarray, demand: np.ndarray, capacity: int, cutting: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Columns (a row each: patterns, and cuts, which have negative numbers) and how often each is used, of the linear program.

    The revised simplex method over a pool of patterns, which starts with those of first-fit decreasing. When none of the
    pool and no cut improves, patterns are generated: for each class the best one that holds it. They are priced halfway
    between the present prices and the best feasible ones so far, which keeps the number of rounds small. Demands are
    raised by hairs, so that every exchange improves and the method ends."""
    n, near, tight = len(sizes), GAP / 4, 1e-6
    raised = demand + 1e-7 * max(1.0, demand.sum()) / n * np.random.default_rng(0).uniform(0.5, 1, n)
    basis, cost = np.diag(capacity // sizes).astype(float), np.ones(n)  # one class each to begin with
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ raised
    cuts = Cuts(sizes, demand, cutting)
    pool = np.array([p for p, _ in first_fit(sizes, demand, capacity)] or [np.zeros(n)], float)
    best, bound, step = None, 0.0, 0

    def generated(prices: np.ndarray) -> tuple[float, np.ndarray]:
        """The value of the best pattern, and the best pattern with each class."""
        value, pattern = knapsack(np.maximum(prices, 0.0), sizes, capacity)
        found = pattern[capacity - sizes]
        found[np.arange(n), np.arange(n)] += 1
        return float(value[-1]), np.unique(found, axis=0)

    while True:
        prices = cost @ inverse
        gains, cut_gains = pool @ prices - 1, cuts.gains(prices)
        k, c = int(gains.argmax()), int(cut_gains.argmax()) if len(cut_gains) else -1
        if gains[k] <= near and (c < 0 or cut_gains[c] <= tight):
            news = []
            for at in ([] if best is None else [(prices + best) / 2]) + [prices]:
                value, found = generated(at)
                feasible = at / max(value, 1 + tight / CUT)
                if feasible @ raised > bound:
                    best, bound = feasible, float(feasible @ raised)
                news = found[found @ prices > 1 + near]
                if len(news) or cost @ used <= (1 + GAP) * bound:
                    break
            if not len(news) or cost @ used <= (1 + GAP) * bound:
                break
            if len(pool) > 20 * n:
                pool = pool[np.argsort(-gains)[: 5 * n]]
            pool = np.concatenate([pool, news])
            continue
        column, price = (pool[k], 1.0) if c < 0 or gains[k] >= cut_gains[c] else (cuts.column(c, n), CUT)
        along = inverse @ column
        ratios = np.where(along > 1e-9, used / np.where(along > 1e-9, along, 1.0), np.inf)
        out = int(ratios.argmin())
        used -= ratios[out] * along
        used[out] = ratios[out]
        basis[:, out], cost[out] = column, price
        step += 1
        if step % 200 == 0:
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ raised, 0.0)
        else:
            row = inverse[out] / along[out]
            inverse -= np.outer(along, row)
            inverse[out] = row
    return basis.T.round().astype(np.int64), np.maximum(np.linalg.solve(basis, demand.astype(float)), 0.0)


def whole_packing(sizes: np.ndarray, demand: np.ndarray, capacity: int, cutting: bool) -> tuple[list[tuple[np.ndarray, int]], list[tuple[int, int, int]]]:
    """Patterns and whole counts that take every piece exactly once, after the cuts (class, size of the first part, count).

    The linear program's, rounded down, then first-fit decreasing for the rest; or that alone where it takes fewer."""
    plain = first_fit(sizes, demand, capacity)
    if not demand.any():
        return plain, []
    columns, used = fractional_packing(sizes, demand, capacity, cutting)
    left, whole, chosen, cuts = demand.astype(np.int64).copy(), demand.astype(np.int64).copy(), [], []
    order = np.argsort(-used).tolist()
    for k in order:
        if (columns[k] < 0).any():
            at, parts = int(columns[k].argmax()), sizes[columns[k] < 0]
            times = min(int(used[k] + 1e-6), int(whole[at]))  # only what the documents are cut from, no parts of it
            if times > 0:
                whole[at] -= times
                left -= times * columns[k]
                cuts.append((int(sizes[at]), int(parts[0]), times))
    for k in order:
        taken = columns[k] > 0
        if taken.any() and not (columns[k] < 0).any():
            times = min(int(used[k] + 1e-6), int((left[taken] // columns[k][taken]).min()))
            if times > 0:
                chosen.append((columns[k], times))
                left -= times * columns[k]
    chosen += first_fit(sizes, left, capacity)
    if sum(t for _, t in plain) <= sum(t for _, t in chosen):
        return plain, []
    return chosen, cuts


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole counts that take every piece exactly once, without cuts."""
    return whole_packing(sizes, demand, capacity, False)[0]


@dataclass(frozen=True)
class Shelf:
    """Ranks from ``first`` on of one class go to sequences from ``sequence`` on, ``each`` to a sequence."""

    size: int
    first: int
    each: int
    sequence: int


@dataclass(frozen=True)
class Cut:
    """``count`` ranks from ``first`` on of one class are cut after ``at`` units; the ranks of their parts, in their own
    classes, begin with ``left`` and ``right``."""

    size: int
    first: int
    count: int
    at: int
    left: int
    right: int


def shelves(histogram: dict[int, int], capacity: int, first_sequence: int, cutting: bool = False) -> tuple[list[Shelf], list[Cut], int]:
    """Where each class's ranks go, which are cut, and the number of sequences used."""
    sizes = np.arange(1, capacity + 1) if cutting else np.array(sorted(histogram), np.int64)
    if not histogram:
        return [], [], 0
    demand = np.array([histogram.get(s, 0) for s in sizes.tolist()], np.int64)
    patterns, found = whole_packing(sizes, demand, capacity, cutting)
    ranked, next_rank = dict.fromkeys(sizes.tolist(), 0), dict(zip(sizes.tolist(), demand.tolist(), strict=True))
    cuts, out, sequence = [], [], first_sequence
    for size, at, times in found:  # the first ranks of a class are cut; parts are ranked after its documents
        starts = []
        for part in (at, size - at):
            starts.append(next_rank[part])
            next_rank[part] += times
        cuts.append(Cut(size, ranked[size], times, at, *starts))
        ranked[size] += times
    for pattern, times in patterns:
        for k in np.flatnonzero(pattern):
            size = int(sizes[k])
            out.append(Shelf(size, ranked[size], int(pattern[k]), sequence))
            ranked[size] += int(times * pattern[k])
        sequence += times
    return out, cuts, sequence - first_sequence


def _cut_up(ranked: DataFrame, cuts: list[Cut], unit: int) -> DataFrame:
    """``ranked`` pieces (..., _size, _rank) with those that are cut replaced by their parts."""
    of: dict[int, list[Cut]] = {}
    for c in sorted(cuts, key=lambda c: c.first):
        of.setdefault(c.size, []).append(c)
    ends = {size: own[-1].first + own[-1].count for size, own in of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, parts = [], []
            for k, (size, rank) in enumerate(zip(batch["_size"].to_pylist(), batch["_rank"].to_pylist(), strict=True)):
                if rank >= ends.get(size, 0):
                    whole.append(k)
                    continue
                cut = next(c for c in reversed(of[size]) if c.first <= rank)
                row, n = batch.slice(k, 1).to_pylist()[0], cut.at * unit
                before = int.from_bytes(row["crcs"][4 * (cut.at - 1) : 4 * cut.at], "little")
                first = row | {"length": n, "ids_crc32": before, "_size": cut.at, "_rank": cut.left + rank - cut.first}
                rest = row | {"start": row["start"] + n, "length": row["length"] - n, "ids_crc32": later_checksum(row["ids_crc32"], before, row["length"] - n), "_size": size - cut.at, "_rank": cut.right + rank - cut.first}
                if "ids" in row:
                    first["ids"], rest["ids"] = row["ids"][:n], row["ids"][n:]
                parts += [first, rest]
            yield batch.take(pa.array(whole, pa.int64()))
            if parts:
                yield pa.RecordBatch.from_pylist(parts, batch.schema)

    return ranked.mapInArrow(run, ranked.schema)


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, classes: int = CLASSES) -> DataFrame:
    """``pieces`` (doc_id, start, length, ids_crc32, ...[, crcs, row]) with sequence_id and offset (of the piece in its sequence).

    Pieces of a whole sequence come first, one to each; ids run from 0. Pieces with ``crcs`` may be cut; a number ``row`` of
    their own spreads equal pieces."""
    spark, unit = pieces.sparkSession, -(-sequence // classes)
    kept = [c for c in pieces.columns if c not in ("crcs", "row")]
    own = [F.col("row")] if "row" in pieces.columns else [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32")]
    rows = pieces.withColumn("_size", F.when(F.col("length") < sequence, F.ceil(F.col("length") / unit)).otherwise(0).cast("long"))
    histogram = {r._size: r["count"] for r in rows.groupBy("_size").count().collect()}  # at most classes + 1 rows
    parts = spark.createDataFrame([(s, -(-n // RANK_ROWS)) for s, n in histogram.items()], "_size long, _parts long")
    full = histogram.pop(0, 0)
    cutting = "crcs" in pieces.columns
    placed, cuts, _ = in_task(spark, lambda: shelves(histogram, sequence // unit, full, cutting))
    placed = [Shelf(0, 0, 1, 0), *placed]
    spots = {}
    for s in placed:
        spots.setdefault(s.size, []).append((s.first, s.each, s.sequence))
    spots_of = spark.createDataFrame(list(spots.items()), "_size long, _spots array<struct<first:long,each:long,sequence:long>>")
    # A number of parts and the shelves of each class are broadcast: bounded by the parameters, whatever the input.
    rows = rows.join(F.broadcast(parts), "_size").withColumn("_part", F.pmod(F.xxhash64(*own), F.col("_parts")))
    earlier = Window.partitionBy("_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_size", "_part").count().select("_size", "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    if cutting:  # no checksum is moved that no cut needs
        rows = rows.withColumn("crcs", F.when(F.col("_size").isin([c.size for c in cuts]), F.col("crcs"))) if cuts else rows.drop("crcs")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_size", "_part").orderBy("doc_id", "start", "length", "ids_crc32", *own)) - 1)
    ranked = ranked.join(counts, ["_size", "_part"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long"))
    if cuts:
        ranked = _cut_up(ranked.select(*kept, "crcs", "_size", "_rank"), cuts, unit)
    ranked = ranked.join(F.broadcast(spots_of), "_size")
    spot = F.element_at(F.filter("_spots", lambda s: s["first"] <= F.col("_rank")), -1)
    ranked = ranked.withColumn("_spot", spot)
    ranked = ranked.withColumn("sequence_id", F.col("_spot.sequence") + F.floor((F.col("_rank") - F.col("_spot.first")) / F.col("_spot.each")))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "_rank")
    offset = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return ranked.withColumn("offset", offset).select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, keep_ids: bool = False, kept: int = WordIds.KEPT) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset.

    A worker keeps the ids of about ``kept`` words, those that come often, from task to task; fewer than usual are dropped
    with the task, which takes less memory and more time."""
    pieces = tokenized_pieces(docs, tokenizer_path, sequence, keep_ids, kept).withColumn("row", F.monotonically_increasing_id())
    return pack_pieces(stored(pieces, "pieces"), sequence)
