"""Registered queries of the training-data operators and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, decontaminate, divergence, kd_shards, langid, line_dedup, periodic, pii, resample, simhash, token_counts, toxicity
from .common import read


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced by surrogates (the key is a test value)."""
    return pii.pseudonymise(read(spark, sf_dir, "documents"), key="registered query").select("doc_id", "text", "n_replaced")


@query("op2_simhash_anchors")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 64-bit SimHash, at most 2 differing bits."""
    return simhash.simhash_digest(read(spark, sf_dir, "documents"))


@query("op3_benchmark_leaks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item up to a fifth of its words edited."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op4_divergence_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, Jensen-Shannon distances to the language references and the verdict of every document."""
    return divergence.quality_rules(read(spark, sf_dir, "documents"))


@query("op5_importance_resampling")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weights of all documents against the good labelled ones, and the Gumbel top-k selection."""
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_subword_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels outside the held-out fold."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op7_kd_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes: k-d tree over source, language and size."""
    return kd_shards.shard_digest(read(spark, sf_dir, "documents"))


@query("op8_language_evidence")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page from its text, markup, address suffix and host."""
    return langid.page_languages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


@query("op9_bpe_backtracking")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with a public byte-level BPE vocabulary and decoded again."""
    return bpe.bpe_digest(read(spark, sf_dir, "documents"), vocabulary())


@query("op10_line_dedup", line_dedup.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 10 characters stay only in the first document that holds them."""
    return line_dedup.line_digest(read(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a hash of its turns: faults, and the cheapest repair by the role grammar."""
    return conversations.conversation_digest(read(spark, sf_dir, "conversations"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents (some get a periodic tail), and the texts without the repeats."""
    return periodic.runs_digest(read(spark, sf_dir, "documents"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents with a public BPE vocabulary with word ends."""
    return token_counts.token_digest(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
