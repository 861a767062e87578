"""Packing: ids of every letter, optimal patterns, cut pieces with right checksums, equal rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbifold.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def test_ids_of_every_letter(tokenizer):
    letters = [chr(c) for c in range(0x80, 0x110000) if chr(c).isalnum()]
    rng = random.Random(3)
    texts = [f"a{c}{rng.choice(packing.WordIds.SIMPLE)}" for c in letters] + [f"{c}{rng.choice(packing.WordIds.SIMPLE)}b{c}?! {c}" for c in rng.sample(letters, 20_000)]
    texts += ["TARİHİ.", "SAHİBİ, YENİ", "İ?#", "क़.", "ড়!", "İ. İ, İ? Aİ#", "ΣΑΣ. ΣΑΣ"]
    words = packing.WordIds(WORDS)
    for start in range(0, len(texts), 5_000):
        some = texts[start : start + 5_000]
        for t, own, e in zip(some, words.encode(some), tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
            assert own.tolist() == e.ids, t


def test_frequent_words_outlive_a_full_table(tokenizer):
    rng = random.Random(4)
    words, asked = packing.WordIds(WORDS, kept=50), []
    alone = words._alone
    words._alone = lambda texts: asked.extend(" ".join(texts).split()) or alone(texts)
    often = ["river", "stone", "Größe,", "keeper;"]
    for _ in range(30):
        text = " ".join(rng.sample([*often * 3, *("".join(rng.choices("abcdefgh", k=7)) for _ in range(40))], 52))
        assert words.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words) <= 50 + 44
    assert all(asked.count(w.rstrip(",;")) == 1 for w in often)  # once each, though the table was full many times
    assert words.encode([]) == []


def test_even_classes_are_paired():
    sizes, demand = np.arange(1, 256), np.full(255, 1_000)
    chosen = packing.whole_patterns(sizes, demand, 256)
    assert (sum(t * p for p, t in chosen) == demand).all() and all((p * sizes).sum() <= 256 for p, _ in chosen)
    assert sum(t for _, t in chosen) <= 127_500 * 1.01  # each class pairs with its complement


@pytest.mark.parametrize("histogram", [{129: 10_000}, {171: 5_000}, {s: 37 * s % 101 for s in range(90, 257)}, {256: 9, 200: 1_000, 3: 5}], ids=["half", "two thirds", "large", "few small"])
def test_cuts_fill_sequences(histogram):
    placed, cuts, n = packing.shelves(histogram, 256, 7, True)
    ranks = {s: n for s, n in histogram.items() if n}
    for c in cuts:
        assert c.first + c.count <= histogram[c.size] and 0 < c.at < c.size
        for size, first in ((c.at, c.left), (c.size - c.at, c.right)):
            ranks[size] = max(ranks.get(size, 0), first + c.count)
    cut = {s: sum(c.count for c in cuts if c.size == s) for s in ranks}
    assert sum(ranks.values()) == sum(histogram.values()) + 2 * sum(cut.values())
    fill = np.zeros(n, np.int64)
    for size, most in ranks.items():
        own = sorted((s for s in placed if s.size == size), key=lambda s: s.first)
        for k, s in enumerate(own):
            end = own[k + 1].first if k + 1 < len(own) else most
            np.add.at(fill, s.sequence - 7 + (np.arange(s.first, end) - s.first) // s.each, size)
        assert (own[0].first if own else most) == cut[size]
    assert fill.max() <= 256 and fill.sum() == sum(s * m for s, m in histogram.items())
    assert n <= 1.02 * fill.sum() / 256 + 3


def test_checksums_of_parts():
    ids = np.arange(1000, dtype="<u4") * 77
    whole, crcs = packing.checksums(ids, 16)
    assert whole == zlib.crc32(ids.tobytes()) and len(crcs) == 4 * 62
    for at in (16, 512, 992):
        before = int.from_bytes(crcs[4 * (at // 16 - 1) : 4 * (at // 16)], "little")
        assert before == zlib.crc32(ids[:at].tobytes()) and packing.later_checksum(whole, before, 1000 - at) == zlib.crc32(ids[at:].tobytes())


def test_documents_of_half_a_sequence_are_cut(spark, tokenizer):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["the", "word", "is", "here", "."], k=2_063)) for _ in range(60)]
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    assert {len(x) for x in ids} == {2_064}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(docs, WORDS, keep_ids=True).collect()
    taken, sequences = {}, {}
    for r in rows:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tolist() and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        taken.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in (*taken.values(), *sequences.values()):
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
    assert all(sum(n for _, n in x) == 2_064 for x in taken.values()) and len(taken) == 60
    assert len(sequences) <= 36 and max(sum(n for _, n in x) for x in sequences.values()) <= 4_096  # 60 without cuts, 31 at least
    plain = packing.pack_documents(docs, WORDS).drop("sequence_id", "offset")
    assert plain.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and plain.count() == len(rows)


def test_equal_rows_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    docs = spark.range(0, 600).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    pieces = packing.tokenized_pieces(docs, WORDS).withColumn("row", F.monotonically_increasing_id())
    parts = pieces.select(F.pmod(F.xxhash64("row"), F.lit(12)).alias("p")).groupBy("p").count().collect()
    assert len(parts) == 12 and max(r["count"] for r in parts) < 100
    rows = packing.pack_documents(docs, WORDS).collect()
    assert len(rows) == 600 and {(r.start, r.length, r.doc_tokens, r.sequence_id) for r in rows} == {(0, 1, 1, s) for s in range(3)}
    assert len({(r.sequence_id, r.offset) for r in rows}) == 600
