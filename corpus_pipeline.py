"""Training-data pipeline: five corpus operators in a row over documents.

Each stage reads all that its predecessor kept, stored as Parquet. All but the last return the columns
of documents. Null and empty texts, ties, repeated rows, empty tables and further columns behave as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import op03_packing, op06_secrets, op07_ranking, op08_mixing, op10_minhash
from sitelens.llm.common import staged, table

#: target shares of tokens, about 0.88 and 0.12 before; what the quality stage rejects needs none
TARGETS = {"good": 0.93, "toxic": 0.07}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts; fitted on the labelled ones among docs."""
    return op07_ranking.accepted(docs, op07_ranking.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates (five words, 0.8)."""
    return op10_minhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return op06_secrets.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their fitted rates, all of one or more: none is dropped."""
    return op08_mixing.mixed(docs, op08_mixing.domain_labels(table(spark, sf_dir, "labels")), TARGETS, least=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row a piece."""
    return op03_packing.pack_documents(docs)


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the trained models nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
