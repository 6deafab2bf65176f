"""Corpus pipeline: quality, toxicity, exact copies, near copies, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``. Models are fitted on the labelled rows of
the whole ``documents`` table in ``sf_dir``; each stage decides on every row it is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkqa.llm import exact_dedup, quality, registry, simhash, toxicity
from sparkqa.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.drop_poor(docs, model)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return registry.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("good_quality", good_quality),
    ("clean_language", clean_language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("packing", packing),
]

#: Models and byte-level fingerprints cannot be written in SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
