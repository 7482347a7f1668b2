"""A corpus made ready for training: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared folder and read back as the next one's ``docs``. All but the last return the columns of
``documents``; the last adds ``copy``.

In every stage texts may be of any length, a row's other columns may be null and extra columns are kept,
whatever their names; an input of no rows gives none. What a stage does with nulls, empty texts, ties and
repeated rows is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontam, mixing, neardup, quality, secrets
from palimpsest.storage import removed, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the additive models, trained on the labels, take for poor or toxic, and null and empty texts.

    Rows are judged one by one, so repeated rows stay or go together, with or without an id; a score at the
    bar keeps the row.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Rows with a null id stay, as do null and empty texts; rows that repeat an id stay or go together.
    """
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a passage of the benchmark, whatever their id, which may be null or repeated.

    Rows with a null or empty text stay; so do all where the benchmark is empty.
    """
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces credentials by their kind, and makes ``n_chars`` right; no row is dropped.

    Null and empty texts stay as they are; repeated rows are changed alike.
    """
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that a source of C characters weighs sqrt(C); ``copy`` counts a document's copies.

    A null source is one of its own, a null size counts as 1, a null id comes first; repeated rows are
    documents of their own, and ties are ordered by a hash of the row.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
]

#: SQL has neither the classifier nor the joins, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            removed(before)
        before = docs
    return docs
