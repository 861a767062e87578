"""Mixing, packing, archives, vectors and search against brute force, and the pipeline."""

import gzip
import hashlib
import io
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbifold.llm import components as cc
from orbifold.llm import mixing, near_dup, packing, queries, topk, vector_dup, warc
from orbifold.storage import shared_path

from .conftest import DOCS, prose

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_components(spark):
    rng = random.Random(0)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_weights():
    tokens = {"a": 800, "b": 100, None: 100}
    w, e = mixing.weights(tokens, mixing.Mix(entropy=0.9, max_passes=None))
    assert abs(-sum(x * math.log(x) for x in w.values()) / math.log(3) - 0.9) < 1e-6 and 0 < e < 1
    w, _ = mixing.weights(tokens, mixing.Mix(entropy=1.0, max_passes=2.0))
    p = mixing.passes(tokens, w, mixing.Mix())
    assert abs(max(p.values()) - 2) < 1e-6 and abs(min(p.values()) - 1) < 1e-9
    assert mixing.weights({"a": 5}, mixing.Mix(entropy=1.0))[0] == {"a": 1.0}


def test_mixing_rows(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 30)), "en", "hot" if i < 400 else f"s{i % 3}" if i % 5 else None, 0) for i in range(600)] + [(600, "", "en", "hot", 0), (601, None, "en", "hot", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    size = {r[0]: max(1, len((r[1] or "").split())) for r in rows}
    source = {r[0]: r[3] for r in rows}
    tokens = {}
    for i, s in source.items():
        tokens[s] = tokens.get(s, 0) + size[i]
    for mix in (mixing.Mix(entropy=0.97, max_passes=3.0), mixing.Mix(entropy=None, max_passes=4.0, budget=1500.0)):
        w, _ = mixing.weights(tokens, mix)
        p = mixing.passes(tokens, w, mix)
        uses = {}
        got = mixing.mix_sources(docs, mix).collect()
        for r in got:
            assert r.tokens == size[r.doc_id]
            uses.setdefault(r.source, {}).setdefault(r["pass"], []).append(r)
        for s, n in p.items():
            for k in range(int(n + 1e-9)):
                assert sorted(r.doc_id for r in uses[s][k]) == sorted(i for i, x in source.items() if x == s)
            part = n - int(n + 1e-9)
            last = uses.get(s, {}).get(int(n + 1e-9), [])
            used = sum(r.tokens for r in last)
            assert used >= part * tokens[s] - 1e-3 and used < part * tokens[s] + 40
            blocks = {r.block: r.order for r in last}
            for b, o in blocks.items():  # all blocks before the last one are whole
                if o < max(blocks.values()):
                    whole = {r.doc_id for r in uses[s].get(0, last) if r.block == b}
                    assert whole == {r.doc_id for r in last if r.block == b}
    assert got[0].__fields__ == [*docs.columns, "tokens", "pass", "block", "order", "weight"]


def test_packing(spark):
    rng = random.Random(9)
    texts = [prose(rng, 1 + int(math.exp(rng.gauss(5, 1.2)))) for _ in range(400)] + [prose(rng, 5000)]
    texts += [None, "", "Don't STOP!!! it's ΣΑΣ İ é \x1c a\x1cb c, x.'s 'tis <|endoftext|> word'. 12,5 A1!", "日本語 テキスト, naïve x.", "é É", "a" * 20_000, "₂ ² ½ ٣"]
    texts += ["hello <|endoftext|> there", "a<|endoftext|>, b<|startoftext|><|endoftext|>! <|endoftext| <|ENDOFTEXT|>x éa<|endoftext|>É"]
    t = Tokenizer.from_file(WORDS)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in enumerate(texts)}
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(texts)], DOCS)
    rows = packing.pack_documents(docs, WORDS, keep_ids=True).collect()
    taken, sequences = {}, {}
    for r in rows:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tolist() and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        taken.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(taken[i]):
            assert start == at
            at += length
        assert at == len(x)
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert sum(map(len, ids.values())) / (len(sequences) * packing.SEQUENCE) > 0.95


def least_sequences(sizes, demand, capacity):
    """A lower bound: no two pieces over half a sequence share one, and pieces of ``least`` or more fit only where there is room for them."""
    best = 0
    for least in range(1, capacity // 2 + 1):
        alone = demand[sizes > capacity - least].sum()
        large = (sizes > capacity // 2) & (sizes <= capacity - least)
        small = (sizes <= capacity // 2) & (sizes >= least)
        room = (demand * (capacity - sizes))[large].sum()
        best = max(best, alone + demand[large].sum() + max(0, math.ceil(((demand * sizes)[small].sum() - room) / capacity)))
    return best


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.arange(1, 65)
    demand = rng.integers(1, 400, 64)
    chosen = packing.whole_patterns(sizes, demand, 64)
    assert (sum(times * p for p, times in chosen) == demand).all() and all((p * sizes).sum() <= 64 for p, _ in chosen)
    assert sum(t for _, t in chosen) <= least_sequences(sizes, demand, 64) * 1.005 + 2
    value, pattern = packing.best_pattern(np.array([3.0, 4.0, 5.0]), np.array([2, 3, 4]), 7)
    assert value == 10 and (pattern @ [2, 3, 4]) <= 7


def test_warc_round_trip(spark):
    rng = random.Random(2)
    same, short = prose(rng, 60), "short"
    rows = [(1, "http://a/\r\nx", same), (2, None, same), (3, "u", short), (4, "u", short), (5, "u", None), (6, "u", ""), (7, "u", "ä😀" * 200), (None, "n", same), (8, "u", "\r\n\r\n" * 60), (9, "u", same[:-1])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == same and i != 1
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
        assert got[i].record_type == ("revisit" if revisit else "response") and got[i].refers_to == (1 if revisit else None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_finds_damage():
    good = warc.record_bytes(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None)
    two = list(warc.members(io.BytesIO(good + good)))
    assert len(two) == 2 and warc.read_page(two[0])["payload"] == b"x" * 500
    assert gzip.decompress(good + good) == two[0] + two[1]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(good + good[:-9])))
    for bad in (two[0].replace(b"xxx", b"yyy", 1), two[0][:-5], two[0] + b"!"):
        with pytest.raises(ValueError):
            warc.read_page(bad)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[500:560] = x[500]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (1000, [float("nan")] * 6, 0), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (None, [1.0] * 6, 0), (5, x[5].tolist(), 0), (1200, [9.0], 1), (1300, [8.0], 1)]
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERIES", 4)
    df = vectors(spark, rows)
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and all(a is not None and math.isfinite(a) for a in v)]
    for q, v in ok:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:10]
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) <= {q for q, _ in ok}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_linked_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(size=(12, 16)) * s for c, s in zip(centres, np.linspace(0.02, 0.4, 40), strict=True)])
    x = np.concatenate([x, x[:5], x[:5] * 3])
    rows = [(i, v.tolist(), int(i % 2) if i < 480 else 0) for i, v in enumerate(x.astype(np.float32))]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, x[0].tolist(), None), (None, x[0].tolist(), 0), (704, [1.0, 2.0], 1)]
    monkeypatch.setattr(vector_dup, "BLOCK", 4)
    got = {r.vec_id: r for r in vector_dup.linked_vectors(vectors(spark, rows)).collect()}
    ok = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and c is not None and i < 700]
    n, parent, pairs = dict.fromkeys([r[0] for r in rows], 0), {i: i for i, *_ in rows}, 0

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    unit = [(i, v / np.linalg.norm(v), c) for i, v, c in ok]
    for a in range(len(unit)):
        for b in range(a):
            if unit[a][2] == unit[b][2] and unit[a][1] @ unit[b][1] >= 0.93:
                n[unit[a][0]] += 1
                n[unit[b][0]] += 1
                pairs += 1
                p, q = root(unit[a][0]), root(unit[b][0])
                parent[max(p, q)] = min(p, q)
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * pairs
    assert all(got[i].n_links <= n[i] for i in got)
    same = np.mean([got[i].component_id == (root(i) if i is not None else None) for i in got])
    assert same > 0.95 and all(got[i].n_links == 0 and got[i].component_id == i for i in (700, 701, 702, 703, 704))
    assert vector_dup.linked_vectors(vectors(spark, [])).count() == 0


def test_odd_inputs(odd_docs, no_docs):
    assert mixing.mix_sources(odd_docs).where("pass = 0").count() == 9 and mixing.mix_sources(no_docs).count() == 0
    pieces = packing.pack_documents(odd_docs, WORDS)
    assert pieces.where("start = 0").count() == 9 and packing.pack_documents(no_docs, WORDS).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [prose(rng, rng.randint(40, 120)) for _ in range(60)]
    texts += [texts[k] for k in range(5)] + [" ".join(w + "$$$" for w in prose(rng, 60).split()) for _ in range(30)] + ["reach me at a.b@c.org " + texts[50][::-1]]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("$$$" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append((name, docs))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for _, df in seen]
    assert ids[0] == {i for i, t in enumerate(texts) if "$$$" not in t}
    assert ids[1] == ids[0] - set(range(60, 65))
    assert ids[2] == ids[1] and seen[2][1].where(F.contains("text", F.lit("[EMAIL]"))).count() == 1
    assert ids[3] == ids[2] and ids[4] == ids[3]
    assert all(df.columns == seen[0][1].columns for _, df in seen[:4])
    counts = seen[3][1].groupBy("doc_id").count().agg(F.max("count").alias("m")).first().m
    assert counts <= 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert near_dup.SIMILARITY == 0.8


def test_mixing_query_tempers_shares(spark):
    """The registered query on a whole table, against plain sums: an exponent between 0 and 1, repeats, and a block that is split."""
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    size = {r.doc_id: max(1, len(re.split(r"[ \t\n\x0b\f\r]+", (r.text or "").strip(" ")))) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    tokens = {s: sum(size[i] for i, x in source.items() if x == s) for s in set(source.values())}
    w, exponent = mixing.weights(tokens, queries.MIX)
    assert 0 < exponent < 1
    budget = max(tokens[s] / x for s, x in w.items())
    rows = queries.op2_mixing(spark, path).collect()
    assert {r["pass"] for r in rows} > {0} and {r.doc_id for r in rows} == set(source)
    split = 0
    for s, n in tokens.items():
        own = [r for r in rows if r.source == s]
        whole = int(budget * w[s] / n + 1e-9)
        assert all(abs(r.weight - w[s]) < 1e-12 for r in own)
        for k in range(whole):
            assert sorted(r.doc_id for r in own if r["pass"] == k) == sorted(i for i, x in source.items() if x == s)
        last = [r for r in own if r["pass"] == whole]
        left = budget * w[s] - whole * n
        assert left - 1e-3 <= sum(size[r.doc_id] for r in last) < left + max(size.values())
        by = {}
        for r in last:
            by.setdefault((r.order, r.block), set()).add(r.doc_id)
        for (_, b), ids in sorted(by.items())[:-1]:
            assert ids == {r.doc_id for r in own if r["pass"] == 0 and r.block == b}
        if by and len(max(by.items())[1]) < len({r.doc_id for r in own if r["pass"] == 0 and r.block == max(by)[1]}):
            split += 1
        assert max((r["pass"] for r in own), default=0) <= whole
    assert max(r["pass"] for r in rows) <= 4


def test_pipeline_leaves_the_session_as_it_was(spark):
    import corpus_pipeline

    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    files = shared_path(spark, "x").rpartition("/")[0].removeprefix("file:")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {k: spark.conf.get(k) for k in before} == before
    assert [f.split("-")[1] for f in os.listdir(files) if f.startswith("stage-")].count("packing") >= 1
    assert not [f for f in os.listdir(files) if f.startswith("stage-") and not f.startswith("stage-packing")]
