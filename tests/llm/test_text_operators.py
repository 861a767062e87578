"""Quality, toxicity, near-duplicates, PII, licenses against brute force, held-out accuracy and odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbifold.llm import licenses, near_dup, pii, quality, toxicity

from .conftest import DOCS, prose


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    texts, rows = [], []
    for i in range(160):
        good, toxic = rng.random() < 0.6, rng.random() < 0.4
        t = prose(rng, rng.randint(30, 90))
        if toxic:
            t = t.replace(" ", f" {rng.choice(['vilestoad', 'vilestub', 'grubface'])} ", 1)
        texts.append(t if good else " ".join(w + "###" for w in t.split()))
        rows.append((i, int(good), int(toxic)))
    return docs_of(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held(i, mod, at):
    return zlib.crc32(str(i).encode()) % mod == at


def test_quality_scores_are_the_discriminant(labelled):
    docs, labels = labelled
    y = {r.doc_id: r.quality for r in labels.collect()}
    x = {r.doc_id: quality.text_features(r.text) for r in docs.collect()}
    train = [i for i in x if not held(i, 4, 2)]
    logs = {}
    by = {c: np.array([x[i] for i in train if y[i] == c]) for c in (0, 1)}
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in by.values()) / len(train)
    for c, v in by.items():
        s = 0.8 * np.cov(v.T, bias=True) + 0.2 * pooled
        s = 0.98 * s + 0.02 * np.diag(np.diag(pooled) + 1e-6) + 1e-9 * np.eye(len(s))
        logs[c] = {i: -0.5 * (z - v.mean(0)) @ np.linalg.inv(s) @ (z - v.mean(0)) - 0.5 * np.linalg.slogdet(s)[1] + math.log(len(v) / len(train)) for i, z in x.items()}
    got = {r.doc_id: r for r in quality.classify_quality(docs, labels).collect()}
    assert len(got) == len(x)
    for i, r in got.items():
        want = 1 / (1 + math.exp(-min(500, max(-500, (logs[1][i] - logs[0][i]) / quality.TEMPERATURE))))
        assert abs(r.score - want) < 1e-6 and r.held_out == held(i, 4, 2) and r.predicted == (r.score >= 0.7)
    out = [i for i in x if held(i, 4, 2)]
    assert np.mean([got[i].predicted == y[i] for i in out]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_toxicity_held_out_and_located(labelled):
    docs, labels = labelled
    y = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.classify_toxicity(docs, labels).collect()}
    out = [i for i in y if held(i, 5, 0)]
    assert all(r.held_out == held(i, 5, 0) for i, r in got.items())
    assert np.mean([got[i].predicted == y[i] for i in out]) > 0.95
    model = toxicity.fit_toxicity(docs, labels)
    for r in toxicity.score_toxicity(docs, model, locate=True).where("toxicity > 0.9").collect():
        assert any(re.search("vilest|grub", r.text[s.start : s.end]) for s in r.offending)


def test_noisy_or():
    logits = [-1.0, 0.5, 3.0, -800.0, 800.0]
    assert toxicity.noisy_or(logits) == 1.0
    p = [1 / (1 + math.exp(-s)) for s in logits[:3]]
    assert abs(toxicity.noisy_or(logits[:3]) - (1 - np.prod(1 - np.array(p)))) < 1e-12
    assert toxicity.noisy_or([]) == 0


def edited(rng, text, share):
    words = text.split()
    for k in rng.sample(range(len(words)), int(len(words) * share)):
        words[k] = prose(rng, 1) + "q"
    return " ".join(words)


def brute_classes(texts):
    weights = near_dup.Weights(np.empty(0, np.uint64), np.empty(0), len(texts))
    n = len(texts)
    common = {}
    for t in texts:
        if t is not None:
            for h in near_dup.shingles(t)[0].tolist():
                common[h] = common.get(h, 0) + 1
    m = sum(t is not None for t in texts)
    often = sorted(h for h, c in common.items() if c >= near_dup.COMMON * m)
    weights = near_dup.Weights(np.array(often, np.uint64), np.array([common[h] for h in often], float), m)
    vectors = [None if t is None else (lambda h, c: (h, weights.of(h, c)))(*near_dup.shingles(t)) for t in texts]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if vectors[i] is None or vectors[j] is None:
                continue
            if texts[i] == texts[j] or (len(vectors[i][0]) and len(vectors[j][0]) and near_dup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(40, 200)) for _ in range(40)]
    base = prose(rng, 150)
    texts += [edited(rng, base, 0.03) for _ in range(60)] + [edited(rng, texts[k], 0.02) for k in range(10)] + [texts[0]] * 30 + [None, "", "", "one two"]
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs_of(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(r.kept == (i == r.class_id) for i, r in got.items())


def test_consistent_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(5)
    a = prose(rng, 600)
    b = edited(rng, a, 0.05)
    weights = near_dup.Weights(np.empty(0, np.uint64), np.empty(0), 2)
    (ha, ca), (hb, cb) = near_dup.shingles(a), near_dup.shingles(b)
    s = near_dup.consistent_samples(np.concatenate([ha, hb]), np.concatenate([weights.of(ha, ca), weights.of(hb, cb)]), np.array([0, len(ha)]))
    j = near_dup.weighted_jaccard((ha, weights.of(ha, ca)), (hb, weights.of(hb, cb)))
    assert abs((s[0] == s[1]).mean() - j) < 0.3
    assert near_dup.similar_pairs([a, b, a], weights, 0.999, np.arange(3), np.arange(3)).sum() == 5
    assert near_dup.similar_pairs([a, b, a], weights, 0.999, np.array([0]), np.array([1, 2])).tolist() == [[False, True]]


def test_shingles_differ_as_their_words_do(monkeypatch):
    rng = random.Random(6)
    longs = ["x" * 300, "x" * 299 + "y", "é" * 200]
    pool = ["a", "b", "ab", "ba", "é", "e\u0301", "\ud800", *longs]
    texts = [rng.choice([" ", "\u2003", "\n\n"]).join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(300)]
    whole = [near_dup.shingle_run(t).tolist() for t in texts]
    monkeypatch.setattr(near_dup, "RUN_WORDS", 7)
    told = {}
    for t, hashes in zip(texts, whole, strict=True):
        assert near_dup.shingle_run(t).tolist() == hashes  # wherever the runs of words end
        words = t.lower().split()
        windows = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
        for window, h in zip(windows, hashes, strict=True):
            assert told.setdefault(window, h) == h
    assert len(set(told.values())) == len(told)


def test_common_shingles_are_counted_exactly(spark):
    rng = random.Random(2)
    texts = [prose(rng, 30) + (" we all share this very common line here" if k % 3 == 0 else "") for k in range(90)]
    w = near_dup.common_shingles(docs_of(spark, texts).select("text"))
    counts = {}
    for t in texts:
        for h in near_dup.shingles(t)[0].tolist():
            counts[h] = counts.get(h, 0) + 1
    want = sorted(h for h, c in counts.items() if c >= 9)
    assert w.hashes.tolist() == want and np.allclose(w.idf, [math.log1p(90 / counts[h]) for h in want])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    found = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if ok(kind, m.group())]
    return sorted(found)


def test_pii_base_spans_match_brute_force(spark):
    rng = random.Random(1)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "0255.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9", "naïve", "😀", ".", "-", " ", "\n", "_", "a@b.c_d@e.f", "4111111111111111"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)] + [None, "", "1 " * 2000, "a." * 3000 + "@" + "b." * 3000 + "c", "1.2.3.4 " * 900]
    docs = docs_of(spark, texts)
    for r in pii.pii_digest(docs).collect():
        want = brute_spans(texts[r.doc_id])
        told = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k in PATTERNS]
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_pii_added_spans_and_redaction(spark):
    texts = ['my token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ok', "call me at (743) 555-3824 today", "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff merged", "nothing here to see", None, "mail a@b.co and 1.2.3.4"]
    found = {r.doc_id: r.spans for r in pii.pii_digest(docs_of(spark, texts)).collect()}
    assert found[0] == "secret:12:52" and found[1].startswith("phone:") and not found[2] and not found[3]
    out = {r.doc_id: r for r in pii.redact(docs_of(spark, texts)).collect()}
    assert out[0].text == 'my token = "[SECRET]" ok' and out[5].text == "mail [EMAIL] and [IP]" and out[5].n_chars == len(out[5].text)
    assert out[3].text == texts[3] and out[4].text is None


def test_licenses(spark):
    texts = [
        "before\nReleased under the MIT License.\nafter", "RELEASED!! UNDER!! THE!! MIT!! LICENSE.", "Licensed under the Apache License,\nVersion 2.0.", "a driving license is needed to pass through here", None, "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ]
    rows = licenses.scan_licenses(docs_of(spark, texts)).collect()
    found = {(r.doc_id, r.license): r for r in rows}
    assert set(found) == {(0, "MIT"), (1, "MIT"), (2, "Apache-2.0"), (6, "MIT")}
    assert found[0, "MIT"].exact and texts[0][found[0, "MIT"].start : found[0, "MIT"].end] == "Released under the MIT License."
    assert not found[6, "MIT"].exact and found[6, "MIT"].added == 1


def test_odd_inputs(odd_docs, no_docs, no_labels, labelled):
    labels = labelled[1]
    for docs, n in ((odd_docs, 9), (no_docs, 0)):
        for some in (labels, no_labels):
            assert quality.classify_quality(docs, some).count() == n
            assert toxicity.classify_toxicity(docs, some).count() == n
        assert near_dup.near_duplicates(docs).count() == n
        assert pii.pii_digest(docs).count() == n
        assert licenses.scan_licenses(docs).count() == 0
    rest = near_dup.drop_near_duplicates(odd_docs)
    assert rest.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in rest.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]  # only the repeated row goes; "" and white space differ in text
    assert near_dup.drop_near_duplicates(no_docs).count() == 0
    assert pii.redact(odd_docs).columns == odd_docs.columns and pii.redact(no_docs).count() == 0
    assert quality.keep_good(odd_docs, no_labels).count() == 9


def test_scores_of_one_text_do_not_depend_on_others(labelled):
    docs, labels = labelled
    model = quality.fit_quality(docs, labels)
    one = quality.score_quality(docs.where("doc_id = 5"), model).first().quality_score
    assert one == quality.score_quality(docs, model).where(F.col("doc_id") == 5).first().quality_score
