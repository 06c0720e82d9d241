"""The corpus pipeline: documents through the stages below, each written and read again before the next.

Toxic documents go, of each class of near duplicates one document stays, repeated passages are cut, documents with
passages of test items go, and what is left comes out as piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm import common, dart_minhash, decontamination, pieces, substrings, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", dart_minhash.stage),
    ("substrings", substrings.stage),
    ("decontamination", decontamination.stage),
    ("pieces", pieces.stage),
]
ORACLE_SQL = None  # learned weights, signatures and alignments are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir))
    return docs
