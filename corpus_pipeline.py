"""A training corpus from documents: filter, deduplicate, redact, mix and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, mixing, packing, pii, quality
from tidemark.llm.shared import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labels of the documents given.

    Null and empty texts are scored as the shortest; rows without an id, or with a repeated one, are scored each. Without labels the
    score is the same for all, and all stay. No rows: none. Other columns stay as they are.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that the n-gram Jaccard join groups (five words, 0.8), the one with the smallest id.

    Texts that are null, empty or without words group with nothing and stay, and so do rows without an id. Of repeated rows of an
    id one stays. Ids may be any longs. No rows: none. Other columns stay as they are.
    """
    return jaccard.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in the text; n_chars is counted anew.

    Null stays null and empty empty; every row stays, repeated ones as well. Without any personal data to learn from, the patterns
    alone decide. No rows: none. Other columns stay as they are.
    """
    return pii.redact_pii(docs, pii.train(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for.

    Null and empty texts have no words and are taken at their source's rate; a null source is one of its own. Repeated rows are taken
    alike. A source without words is not taken. No rows: none. Other columns stay as they are.
    """
    return mixing.mix_sources(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences that the documents fill.

    Null and empty texts are the end id alone; repeated rows are packed each. No rows: none. Other columns go.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("personal data", personal_data_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
