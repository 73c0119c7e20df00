"""A training-data pipeline: toxicity, quality rules, near duplicates, mixing to
target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. Each works on all that its predecessor kept.

A toxicity model, mixing by hashed random numbers and BPE can't be expressed in
SQL, so ``ORACLE_SQL`` is None; tests hold the pipeline against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, jaccard, mixing, quality_rules, toxicity
from ledgerline.llm.common import documents, forget, kept, scratch, written


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain rejects. It is fitted on a
    bounded sample of the labelled rows."""
    chain = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, chain)


def rejected_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the current policy of the rule ledger rejects."""
    return quality_rules.keep_documents(docs)


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80% of its five-word shingles."""
    return jaccard.keep_one(docs)


def sources_are_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.replicate(docs)


def documents_are_encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return bpe.digests(docs, *bpe.vocabulary())


STAGES = [
    ("toxicity", toxic_documents_go),
    ("quality_rules", rejected_documents_go),
    ("near_duplicates", near_duplicates_go),
    ("mixing", sources_are_mixed),
    ("bpe", documents_are_encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows. What a stage wrote and
    what it read goes once its result is written."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            now = kept(written(stage(spark, docs, sf_dir), name))
        if last is not None:
            forget(spark, last)
        docs = last = now
    return STAGES[-1][1](spark, docs, sf_dir)
