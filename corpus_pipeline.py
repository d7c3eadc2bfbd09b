"""A corpus pipeline of operators from ``cliploom.llm``; each stage works on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cliploom.llm import decontamination, jaccard, packing, pii, toxicity
from cliploom.llm.common import kept, prepared, table
from cliploom.llm.queries import BYTE_VOCABULARY, SURROGATE_KEY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that it rejects go."""
    return toxicity.reject(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of linked documents the one of smallest doc_id stays."""
    prepared(spark)
    return jaccard.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: occurrences of test items are cut out; documents that are mostly test items go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data becomes surrogates."""
    prepared(spark)
    return pii.pseudonymized(docs, SURROGATE_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of all documents that are left, by sequence."""
    prepared(spark)
    return packing.pack_documents(docs, BYTE_VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("pii", replace_personal_data),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None  # learned scores, surrogates and token ids are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
