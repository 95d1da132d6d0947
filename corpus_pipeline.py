"""A training corpus from raw documents: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import stages
from kinweave.operators.skew import cut

STAGES = [
    ("quality_classifier", stages.quality),
    ("ngram_jaccard", stages.near_duplicates),
    ("decontamination", stages.decontaminated),
    ("secret_scan", stages.redacted),
    ("best_fit_packing", stages.packed),
]

#: The stages learn, hash and pack; SQL cannot express them. tests/llm compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
