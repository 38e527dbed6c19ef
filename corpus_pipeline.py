"""A training corpus from raw documents, in stages that each read what the one before has written.

Each stage fits or counts on the rows it is given, so it can also be used alone.  Rows keep the columns of
``documents`` up to the last stage, which returns the packed pieces.  Null texts count as empty, repeated rows are
judged alike until the near-copy stage keeps one of them, and an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, ngram_join, packing, quality, queries, toxicity
from tickloom.llm.common import small_batches, table
from tickloom.session import delete_path, shared_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are more likely bad than good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return ngram_join.keep_one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth or more stands in the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 tokens."""
    small_batches(spark)
    return queries.with_digest(packing.pack(docs))


STAGES = [
    ("quality classifier", good),
    ("toxicity", civil),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", unseen),
    ("packing", packed),
]

#: Stages fit models and tokenise, which SQL does not express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, previous = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if previous:
            delete_path(spark, previous)
        docs, previous = spark.read.parquet(path), path
    return docs
