"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import chat, decontam, htmltext, licenses, mixing, neardup, quality, repeats, secrets, transport

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elementary packets of one transport stream a document, which carries its text, some with lost packets.

    No table has media, so the column is written first, from all documents; the parser sees only the bytes.
    """
    return transport.demux(transport.mux(_read(spark, sf_dir, "documents")))


def op2_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document by additive models trained on the labels."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).drop("text")


def op3_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and main text of every page."""
    return htmltext.extracted(_read(spark, sf_dir, "pages"))


def op4_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of which another has at least half of all word 3-grams of the two: its class and number of links."""
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a mix at the square root of the sources' sizes draws, and how often."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mixing.mix(docs).select("doc_id", "source", "copy")


def op6_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples of all assistant turns."""
    return chat.expand(_read(spark, sf_dir, "conversations"))


def op7_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified overlaps of documents with benchmark items."""
    return decontam.find_overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong credentials, and weak parts that complement one another."""
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op9_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements, the template each compresses best with, and how its wording differs."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op10_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 tokens or more that several documents share."""
    return repeats.repeated(_read(spark, sf_dir, "documents"))


ALL = (op1_transport_streams, op2_additive_quality, op3_text_density, op4_signature_tree_join, op5_systematic_mix, op6_prefix_target, op7_spaced_seed_leaks, op8_linked_secrets, op9_license_compression, op10_bwt_repeats)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op5_systematic_mix": mixing.SQL, "op6_prefix_target": chat.SQL}
