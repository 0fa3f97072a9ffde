"""The registered queries of the corpus operators, with production parameters; ``ORACLE_SQL`` has the SQL of those that it can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm import language_id, quality_classifier
from trackweave.llm.bpe import encode_decode
from trackweave.llm.common import read_table
from trackweave.llm.fill_middle import fill_in_middle
from trackweave.llm.fingerprints import fingerprints
from trackweave.llm.ngram_join import jaccard_components
from trackweave.llm.oracles import ORACLE_SQL
from trackweave.llm.packing import pack
from trackweave.llm.quality_rules import quality_rules
from trackweave.llm.substring_dedup import substring_dedup
from trackweave.llm.suffix_dedup import suffix_dedup
from trackweave.llm.superminhash import near_duplicates
from trackweave.llm.token_counts import token_counts
from trackweave.llm.whitening import whiten


def vocabulary(name: str) -> Path:
    """Where a public tokenizer's file is on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_classifier.grade(docs, quality_classifier.learned(docs, read_table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learned(docs))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").read_text())


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken").read_bytes())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"), width=100).drop("kept")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json").read_text())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), width=13).drop("kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"), components=32)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(read_table(spark, sf_dir, "documents")).drop("output")


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=5, num=85, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_language_id, op3_ngram_join, op4_token_counts, op5_byte_bpe, op6_suffix_dedup, op7_fingerprints, op8_quality_rules, op9_packing, op10_substring_dedup, op11_whitening, op12_fill_middle, op13_superminhash)
}

__all__ = ["ORACLE_SQL", "QUERIES", "vocabulary"]
