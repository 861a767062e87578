"""Corpus pipeline: quality filter, near-duplicate removal, PII redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it to the shared folder and
reads it again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.

Null and empty texts are documents like any other: they are scored as empty texts, and stay where these are not
rejected. Rows with a null doc_id are kept by all stages and belong to no class of copies; of rows that repeat a doc_id
and its text one stays. Null sources are one source. Texts of any length are read whole. Ties go to the smaller
doc_id, or to an order fixed by hashes. Empty tables give empty results. Further columns of ``documents`` pass through
all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orbifold.llm import mixing, near_dup, packing, pii, quality
from orbifold.llm.common import Stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Sources as even as can be with none used more than twice; the budget is the least with which every document is used.
MIX = mixing.Mix(entropy=0.9999, max_passes=2.0)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dup.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in the mix."""
    return mixing.mix_sources(docs, MIX).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), kept=200_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: Fitted models, consistent samples and hash permutations are not expressible in SQL; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        made = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if read:
            read.discard()
        docs, read = made.df, made
    return docs
