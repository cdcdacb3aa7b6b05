"""Corpus pipeline: ``STAGES`` turn ``documents`` into clean, distinct, decontaminated and tokenised documents.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns of
``documents``, also extra ones of whatever name. Rows keep their ids; rows without an id, and null or empty texts, pass all stages
unless their text is toxic; texts of any length are processed whole; repeated rows share the fate of their id; of equally good
copies the one with the smallest id stays; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qaspark.llm import bpe, decontamination, minhash_dedup, substring_dedup, toxicity
from qaspark.llm.common import checkpointed, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return minhash_dedup.drop_near_duplicates(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id holds are cut out of the text."""
    return substring_dedup.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``documents`` with tokens, n_tokens and the digest of what the tokens decode to."""
    return bpe.with_tokens(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: SQL can't express the fitted classifier, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
