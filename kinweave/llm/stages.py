"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each around one operator.

Every stage works on all rows it is given and keeps their columns, but for the last,
which returns packed sequences. Rows without an id are judged by their text where a stage
does that and stay where a stage decides by id; of rows that share an id all stay or go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm import decontaminate, line_quality, ngram_join, packing, secret_scan
from kinweave.llm.queries import held_out, tokenizer_path
from kinweave.operators.skew import cut_counted

#: Up to so many ids (8 bytes each) are sent to every executor; more are joined through a shuffle.
SENT = 2_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is among ``ids``. The size of the list is checked first."""
    listed, n = cut_counted(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(listed) if n <= SENT else listed, "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts, with a score of 0.7 or more. It learns from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return line_quality.accepted(docs, line_quality.fit(docs, labels), least=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Five words, similarity 0.8 or more.

    Documents without words are no duplicates of anything.
    """
    groups = ngram_join.similar_components(docs, n=5, threshold="0.8")
    return without(docs, groups.where("component_id <> doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without(docs, decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and ``n_chars`` brought up to date."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row per piece of a document."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0)
