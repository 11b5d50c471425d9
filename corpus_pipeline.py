"""A corpus pipeline of five stages, each an operator of ``llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs, so a stage
that loses executors only runs its own tasks again.  All but the last return the columns of documents.

Cases, for every stage: an empty table gives an empty one; extra columns stay as they are, and no helper column can meet them; repeated rows
are rows of their own, but for near duplicates; a null doc_id is an id like others, but is never learned from and never grouped by likeness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm.byte_bpe import tokenised
from llm.common import scratch, table
from llm.language_id import keep_identified
from llm.mixing import mixed_documents
from llm.near_dup import keep_first_of_group
from llm.secret_scan import redacted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go: narrow margins, and null, empty or other texts without a letter."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest id (five words, similarity 0.8).

    Rows that repeat id and text are one; different texts under one id, or under none, all stay.
    """
    return keep_first_of_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets of any length are replaced by a mark; all documents stay, null texts as they are."""
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document comes once for each pass that takes words of it; null and blank texts have none."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts; a null text has no tokens."""
    return tokenised(docs)


STAGES = [("language_id", language), ("near_dup", near_duplicates), ("secret_scan", secrets), ("mixing", mixture), ("byte_bpe", tokens)]

#: Compression sizes, the forest and BPE merges are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
