import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    """Sentences of made-up words."""
    parts = ["an", "er", "the", "ti", "on", "ou", "ble", "ing", "ha", "st", "re", "wh"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    for k in range(0, n, 11):
        words[k] = words[k].capitalize()
        words[k - 1] += "."
    return " ".join(words)


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null, repeated and tied ids, a very long text, and columns that clash with operators' own."""
    rows = [(1, None), (2, ""), (None, "a word or two here and there"), (3, "same text in two rows of one id"), (3, "same text in two rows of one id"), (4, " \n\t "), (5, "x" * 50_000), (6, "long words " * 20_000), (7, None)]
    return spark.createDataFrame([(i, t, "en", None if i == 2 else "s", 9, 9, "b", 0.5, "q") for i, t in rows], DOCS + ", tokens int, block string, score double, node string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
