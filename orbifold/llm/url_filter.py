"""URL filter: rules decide first; other URLs by naive Bayes over the words of segmented host names and paths.

A rule (host, path) fits its host and all subdomains of it where the URL's path starts with the rule's; the longest rule
that fits decides (of equal length the one with the longer host, then a block). For URLs without a rule a host is cut at
all but letters and digits, and each name into the words of greatest product of unigram probabilities (Viterbi), so that
``cheapcasinowin`` becomes ``cheap casino win``. The unigram counts are those of all words in the pages' own text; the
:data:`VOCABULARY` most frequent words are known, other letters cost by their number. Paths are cut at all but letters
and digits, and segmented likewise. Numbers are one word.

The multinomial naive Bayes is counted over all URLs that rules decide, without the words of the rules themselves, which
would only repeat them, and given pseudo-counts for seed words, which are shares of all words counted, so that the result
does not depend on the number of rows. Words are counted in :data:`BUCKETS` hashed places, which bounds the model. Both verdicts are equally likely beforehand; a URL is blocked
where its log odds are above 0, so that one without any word is allowed.

Null URLs, and those without ``://``, have an empty host and path; rules never fit an empty path. URLs and pages of any
length are read whole. Null and repeated page_ids are rows like any other. Without any URL that rules decide, seeds
alone decide. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, tidy
from .lexical import pieces

#: Words that the segmentation knows, their greatest length in bytes, and the places in which words are counted.
VOCABULARY, LONGEST, BUCKETS = 65_536, 24, 1 << 18
#: Words whose hosts and paths are unwanted, their share of all words of blocked URLs, and of the text that unigrams are counted in.
SEEDS = ("ads", "adult", "bet", "bets", "bonus", "casino", "cheap", "crack", "escort", "gamble", "jackpot", "keygen", "loan", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "win", "xxx")
SEED_SHARE, SEED_TEXT = 0.002, 1e-4
#: Added to each word's count of either verdict.
SMOOTHING = 1.0
#: Different words that a task counts before it sends them on.
_HELD = 200_000
_TAG = re.compile(rb"<[^>]*>")
_PART = re.compile(rb"[^a-z0-9\x80-\xff]+")
_NUMBER = b"0"


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A to Z lower-cased, and the path of a URL; both empty where it has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(pages: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages (page_id, url); null rule and verdict where none fits."""
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    best = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block"))
    fits = [((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path)) for r in best]
    found = [F.coalesce(F.lit(None).cast("string"), *(F.when(fit, F.lit(value)) for fit, value in zip(fits, values, strict=True))) for values in ([r.host + r.path for r in best], [r.verdict for r in best])]
    return rows.withColumns({"rule": found[0], "verdict": found[1]})


def _told(found: Counter, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(list(found.values()), pa.int64())], names)


def word_counts(html: DataFrame) -> DataFrame:
    """(word, n) of all words in the text of pages (html), without their tags; counted in tasks first."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for page in batch.column(0):
                for some in pieces(_TAG.sub(b" ", page.as_py() or b"")):
                    found.update(some)
                    if len(found) > _HELD:
                        yield _told(found, ["word", "n"], pa.binary())
                        found.clear()
        yield _told(found, ["word", "n"], pa.binary())

    words = html.select(F.col("html").cast("binary")).mapInArrow(count, "word binary, n long")
    return words.where((F.octet_length("word") <= LONGEST) & ~F.col("word").cast("string").rlike("[0-9]")).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """Cuts names into known words by their unigram costs (negative log probabilities)."""

    cost: dict[bytes, float]
    unknown: float
    silent: frozenset[bytes] = frozenset()
    known: dict[bytes, tuple[bytes, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[bytes, int], rules: Iterable[Rule] = ()) -> Words:
        """``counts`` of the known words; seeds are known as well. The words of ``rules`` are left out of URLs."""
        total = sum(counts.values()) or 1
        counts = counts | {s.encode(): max(counts.get(s.encode(), 0), math.ceil(SEED_TEXT * total)) for s in SEEDS}
        total = sum(counts.values())
        words = cls({w: math.log(total / n) for w, n in counts.items()}, math.log(total) + 1)
        words.silent = frozenset(w for r in rules for part in words.of_url(r.host, r.path) for w in part)
        return words

    def segment(self, name: bytes) -> tuple[bytes, ...]:
        """The words of a name; letters between known words stay together as one, and cost the more the longer they are.

        Of equal costs the longest last word wins."""
        if name in self.known:
            return self.known[name]
        letter = math.log(26)
        last, run = [0.0], [math.inf]  # least cost of each prefix that ends with a known word, and in other letters
        last_at, run_at = [0], [0]  # where that word or run starts
        for end in range(1, len(name) + 1):
            low, start = math.inf, 0
            for a in range(max(0, end - LONGEST), end):
                known = self.cost.get(name[a:end])
                if known is not None and (cost := min(last[a], run[a]) + known) < low:
                    low, start = cost, a
            last.append(low)
            last_at.append(start)
            opened, longer = last[end - 1] + self.unknown + letter, run[end - 1] + letter
            run.append(min(opened, longer))
            run_at.append(end - 1 if opened < longer else run_at[end - 1])
        words, end = [], len(name)
        closed = last[end] <= run[end]
        while end:
            start = last_at[end] if closed else run_at[end]
            words.append(name[start:end])
            closed = not closed or last[start] <= run[start]  # a known word stands before every run
            end = start
        if len(self.known) > 100_000:
            self.known.clear()
        if len(name) <= 256:
            self.known[name] = tuple(reversed(words))
        return tuple(reversed(words))

    def of_url(self, host: str, path: str) -> tuple[list[bytes], list[bytes]]:
        """The words of a host and of a path; numbers are one word."""

        def words(text: str) -> list[bytes]:
            parts = (p for p in _PART.split(text.encode().lower()) if p)
            return [w for p in parts for w in ((_NUMBER,) if p.isdigit() else self.segment(p))]

        return words(host), words(path)

    def telling(self, host: str, path: str) -> list[bytes]:
        """The words of a URL that are not the rules' own."""
        return [w for part in self.of_url(host, path) for w in part if w not in self.silent]


def place(word: bytes) -> int:
    """Where a word is counted."""
    return zlib.crc32(word) % BUCKETS


@dataclass
class Bayes:
    """Log odds of a block for each place."""

    odds: np.ndarray

    @classmethod
    def of(cls, places: np.ndarray, block: np.ndarray, allow: np.ndarray) -> Bayes:
        """From counts of words in blocked and allowed URLs by place."""
        counts = np.zeros((2, BUCKETS))
        counts[0, places], counts[1, places] = block, allow
        seeds = np.unique([place(s.encode()) for s in SEEDS])
        counts[0, seeds] += max(1.0, SEED_SHARE * counts[0].sum())
        seen = max(1, int((counts.sum(axis=0) > 0).sum()))
        logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * seen)
        return cls(np.where(counts.sum(axis=0) > 0, logs[0] - logs[1], 0.0))  # a word never met says nothing

    def score(self, words: list[bytes]) -> float:
        return float(math.fsum(self.odds[place(w)] for w in words))


def bayes_counts(rows: DataFrame, words: Words) -> DataFrame:
    """(place, block, allow) of the rows (host, path, verdict) that rules decide; counted in tasks first."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {"block": np.zeros(BUCKETS, np.int64), "allow": np.zeros(BUCKETS, np.int64)}
        for batch in batches:
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in words.telling(host, path):
                    found[verdict][place(w)] += 1
        at = np.flatnonzero(found["block"] + found["allow"])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found["block"][at]), pa.array(found["allow"][at])], ["place", "block", "allow"])

    sent = rows.select("host", "path", "verdict").mapInArrow(count, "place int, block long, allow long")
    return sent.groupBy("place").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, log_odds) of ``pages`` (page_id, url, html): the host's words and the
    log odds of a block by the method, whichever way the verdict came."""
    spark = pages.sparkSession
    counted = Stored(word_counts(pages), "words")
    top = counted.df.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    counted.discard()
    rules = list(rules)
    words = Words.of(dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)), rules)
    rows = ruled(pages, rules)
    told = bayes_counts(rows.where(F.col("verdict").isNotNull()), words).toArrow()  # BUCKETS rows at most
    bayes = Bayes.of(*(told[c].to_numpy() for c in ("place", "block", "allow")))
    model = spark.sparkContext.broadcast((words, bayes))

    @tidy
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, odds = model.value
        for batch in batches:
            verdicts, names, scores = [], [], []
            for host, path, verdict in zip(*(batch[c].to_pylist() for c in ("host", "path", "verdict")), strict=True):
                scores.append(odds.score(known.telling(host, path)))
                names.append([w.decode("utf-8", "replace") for w in known.of_url(host, "")[0]])
                verdicts.append(verdict or ("block" if scores[-1] > 0 else "allow"))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "words", "log_odds"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, words array<string>, log_odds double")
