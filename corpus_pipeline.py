"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and hands documents on.

All stages but the last return the columns of ``documents``; the last returns
the training stream: a row for each pass over a document, with mix_pass,
mix_taken and mix_position.

Defined cases.  A null text has no words and goes in the first stage, as all
texts of fewer than 20 words do; a null source is a source of its own; a null
doc_id is never a representative.  Repeated rows: one stays, after the second
stage.  Ties: the least doc_id stays.  Very long texts are worked on whole.  An
empty table passes as an empty one through every stage, and an empty benchmark
removes nothing.  Extra columns, whatever their names, are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import common, decontaminate, jaccard, mixing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; so do documents that fail the base rules or are left depleted.  Null texts fail; null sources are one host; copies count once."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 75 % alike texts stays: the least doc_id, of its repeated rows one.  Texts without words stay, alike to nothing."""
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  Null texts and null items hold nothing."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows it.  Null texts stay null."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream of the mix, sorted by training position.  Texts without words take no place; equal rows are separate documents."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
]

#: The components and the hashed line and stream orders are not expressed in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
