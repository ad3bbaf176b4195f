"""A training corpus from raw documents: rules, near-dedup, personal data, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); run() writes what a stage returns as
Parquet to the shared folder and reads it again as the next one's docs. All but the last
return the columns of documents, also of an empty table; further columns are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqmill.llm import host_rules, mixing, near_dedup, packing, pii
from seqmill.llm.common import stash, tables_of


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host does worse than hosts may, go.

    Null texts have no words and go; repeated rows are judged one by one; a null source is a host.
    """
    return host_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays, a null one being the least.

    Rows of one doc_id are one document and stay or go together; texts without words stay.
    """
    return near_dedup.keep_firsts(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts and n_chars counted anew; null texts stay null; no row goes."""
    return pii.mask_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most one and a half times as often as the largest; none is cut.

    Rows are in the mixture's order, a block a file, so that the next stage packs a block's documents
    together. Repeated and null rows are dealt as any others; an empty table stays empty.
    """
    blocks = max(64, docs.rdd.getNumPartitions())
    return mixing.in_order(mixing.mix_documents(docs, mixing.Mix(repetition_limit=1.5, blocks=blocks)), blocks)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 1024 tokens; a null text is its end alone.

    A document that the mixture repeats is packed once for each time, each time whole.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Minwise trees, Luhn sums and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
