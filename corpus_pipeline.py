"""Corpus pipeline: classifier, near-dedup, substring dedup, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept, and returns a table; all but the
last return the columns of ``documents``.  ``run`` writes every stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import classifier, jaccard, mixing, sentencepieces, substring
from spanweave.llm.queries import TOKENIZERS
from spanweave.llm.shared import stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents given."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more) stays."""
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that also stand in an earlier document are cut out."""
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that sources meet their targets."""
    return mixing.emit(docs, stage=stage)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return sentencepieces.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", piece_ids),
]

#: A trained classifier and an automaton have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
