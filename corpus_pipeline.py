"""A training corpus from raw documents: rules, language, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all
but the last return the columns of ``documents``. Rows without an id go in the first
stage, as no later decision could name them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import language_id
from trackweave.llm.common import read_table, written
from trackweave.llm.ngram_join import jaccard_components
from trackweave.llm.packing import pack
from trackweave.llm.quality_rules import quality_rules
from trackweave.llm.queries import vocabulary
from trackweave.llm.suffix_dedup import repeated_spans, without_spans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least calibrated probability of the predicted language.
LEAST_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a proven cutoff go."""
    kept = quality_rules(docs, read_table(spark, sf_dir, "labels")).where("kept").select("doc_id")
    return docs.select(*COLUMNS).join(kept.distinct(), "doc_id", "left_semi")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is less likely than ``LEAST_SCORE``, go; without any labelled language only the former."""
    model = language_id.learned(docs)
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    judged = language_id.identify(docs, model, keep=COLUMNS[1:])
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at four fifths of their five-word shingles the one with the smallest id stays."""
    kept = jaccard_components(docs, k=5, num=4, den=5).where("doc_id = component_id").select("doc_id")
    return docs.select(*COLUMNS).join(kept.distinct(), "doc_id", "left_semi")


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters with a byte in a repeated 100-byte string are cut out; a document of which nothing stays goes."""
    cut = without_spans(docs, repeated_spans(docs, width=100), 100, keep=("lang", "source", "n_chars"))
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    left = cut.where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", length.alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json").read_text())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("language", language_stage),
    ("near copies", near_copy_stage),
    ("repeated passages", passage_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the learned, graph and tokenizer stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
