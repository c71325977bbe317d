"""The corpus pipeline: quality rules, quality classifier, near-duplicates, benchmark decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexigauge.llm.bpe import bpe_digests
from lexigauge.llm.common import read, staged
from lexigauge.llm.decontamination import drop_contaminated
from lexigauge.llm.pu_classifier import keep_predicted
from lexigauge.llm.quality_rules import keep_good
from lexigauge.llm.simhash_similar import drop_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the divergence verdict rejects go. Null and empty texts fail the base rule."""
    return keep_good(docs.select(*COLUMNS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 go. Trained on the labels of documents that are still there."""
    return keep_predicted(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of the five-word shingles) the document of smallest id stays.

    SimHash fingerprints give the candidates first; an exact join adds what lies beyond their radius.
    """
    return drop_near_duplicates(docs.select(*COLUMNS), similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return drop_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: The classifier and the tokens cannot be expressed in SQL; the stages are tested in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; all but the last are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
