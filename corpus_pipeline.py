"""The stages that turn ``documents`` into token files for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate, mixing, simhash, token_files, toxicity
from paperloom.llm.common import drop_staged, staged, staged_folders, table, tokenizer_definition

ORACLE_SQL = None  # the classifier, the alignment and the codes are beyond SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that their sources meet their target weights."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids go to Huffman-coded files; what is read back from them is described, a row a document."""
    return token_files.round_trip(docs, tokenizer_definition())


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is written and read again.

    What a stage has staged, its input too, is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    before = staged_folders()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_staged(spark, [f for f in staged_folders()[:-1] if f not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
