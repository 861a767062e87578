"""Places where an operator once did less than its whole job."""

import random

import numpy as np
import pytest

from orbifold.llm import licenses, vector_dup

from .conftest import prose


def found_in(text):
    return [(f["license"], text[f["start"] : f["end"]]) for f in licenses.scan_text(text)]


def test_licenses_inside_prose():
    rng = random.Random(1)
    for wordings in licenses.TEMPLATES.items():
        for wording in wordings[1]:
            around = prose(rng, 80), prose(rng, 80)
            line = f"{around[0]} {wording} {around[1]}"
            assert found_in(line) == [(wordings[0], wording)], line
            wrapped = f"{around[0]}\n{wording}\n{around[1]}".replace(" ", "\n", 5)
            assert (wordings[0], wording) in found_in(wrapped)


def test_every_license_of_a_line():
    mit, apache = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["Apache-2.0"][0]
    assert found_in(f"Authors may choose: {mit} {apache}") == [("MIT", mit), ("Apache-2.0", apache)]
    assert found_in(f"{mit} For the code. {mit} For the rest.") == [("MIT", mit)] * 2


def test_licenses_over_line_ends(spark):
    rng = random.Random(2)
    mit = licenses.TEMPLATES["MIT"][1].replace(" ", "\n")
    texts = [f"{prose(rng, 6_000)}\n{mit}\n{prose(rng, 6_000)}".replace(". ", ".\n"), "Made by us. All rights\nreserved.", "All\n#            rights\n#            reserved."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r.doc_id, r.license, texts[r.doc_id][r.start : r.end]) for r in licenses.scan_licenses(rows).orderBy("doc_id").collect()]
    assert len(texts[0]) > 60_000 and found == [(0, "MIT", mit), (1, "Proprietary", "All rights\nreserved."), (2, "Proprietary", texts[2])]


@pytest.mark.parametrize("move", [2_000, 1])  # the label compared whole, and by tables
def test_links_of_vectors_with_a_common_direction(spark, monkeypatch, move):
    monkeypatch.setattr(vector_dup, "MOVE", move, raising=False)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2_000, 64))
    x = 0.9 / 8 + np.sqrt(1 - 0.81) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=(200, 64))
    u -= (u * x[:200]).sum(axis=1, keepdims=True) * x[:200]
    c = rng.uniform(0.93, 0.95, size=(200, 1))
    x[200:400] = c * x[:200] + np.sqrt(1 - c * c) * u / np.linalg.norm(u, axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = int((np.triu(x @ x.T, 1) >= 0.93).sum())
    found = sum(r.n_links for r in vector_dup.linked_vectors(rows).collect()) / 2
    assert 0.96 * links <= found <= links
    if move > 1:
        assert found == links
