"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that it gets, and is written as Parquet and read back
before the next. The first four return the columns of documents: rejected documents go, of each near-duplicate class
the smallest doc_id stays, documents that hold a benchmark item go, secrets are replaced by a mark. The last packs
what is left. Null and empty texts are rejected by the first stage's word rule; an empty table passes all stages.
SQL can't express the trained and iterative stages; the tests of their operators hold each against brute force or held-out
accuracy, and the pipeline's own tests check what its stages keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrarow.llm import decontaminate, hilbert_pack, near_dedup, quality_crf, secret_cnn
from terrarow.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the line field keep."""
    return quality_crf.judge(docs, quality_crf.fit_on_labels(docs, table(spark, sf_dir, "labels")), keep_columns=True)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced."""
    return secret_cnn.redact(docs, secret_cnn.fit(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return hilbert_pack.pieces(hilbert_pack.pack(docs))


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
