"""Corpus pipeline: quality, toxicity, near duplicates, personal data, packing.

Every stage works on what its predecessor kept. In :func:`run` each stage's
result is written to the shared folder and read again, so that a lost executor
never repeats an earlier stage. How nulls, repeated rows, ties, long texts, empty
tables and clashing names come out is stated in :mod:`lectern.llm.stages`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import stages
from lectern.llm.tables import table
from lectern.plans.scratch import Scratch

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard", stages.drop_near_duplicates),
    ("personal_data", stages.redact_personal_data),
    ("best_fit_packing", stages.pack_sequences),
]

#: Compression distance has no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over all of ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
