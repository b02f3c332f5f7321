"""From raw documents to packed sequences: five stages, each one operator of packrel.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packrel.llm import exact_dedup, mixing, neardup, packing, toxicity
from packrel.llm.common import materialize, table
from packrel.llm.queries import DOMAIN_WEIGHTS, LANG_WEIGHTS


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 and more go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles, a similarity of 0.8."""
    return neardup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, share=0.6, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_dedup_stage), ("near dedup", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Toxicity, near-dedup and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
