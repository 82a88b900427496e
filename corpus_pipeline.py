"""Corpus pipeline: (name, function) stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and calls one operator of :mod:`talentlake.llm`. All but the last return the
columns of ``docs`` unchanged; the last adds the mixing columns and repeats a
document for each epoch that takes it. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talentlake.llm.common import materialize, read
from talentlake.llm.decontaminate import decontaminate
from talentlake.llm.exact_dedup import drop_exact_copies
from talentlake.llm.mixing import corpus_levels, corpus_weights, mix
from talentlake.llm.simhash import drop_near_duplicates
from talentlake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from this folder's labels, does not reject."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the least id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the token budget, in epochs."""
    return mix(docs, corpus_levels(), corpus_weights())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to all that its predecessor kept."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None     # near duplicates and the trained stage cannot be expressed in SQL; see tests/llm
