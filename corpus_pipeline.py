"""From documents to packed sequences; each stage's output is written and read again as the next one's docs.

Stages but the last return the columns of documents. The classifier is trained on the
table's labels; rows it predicts bad go. Then one of each group of equal texts stays, one of
each class of near duplicates, words in windows that an earlier document has go (n_chars
follows), and what is left is packed with the ids of each piece beside the digest columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import exact_dedup, near_dedup, packing, quality_classifier, substring_dedup
from lexloom.llm.support import Stage, prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_documents(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=True)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", packed)]

#: The classifier and the signatures are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before it are written to the shared checkpoint folder."""
    prepare(spark)
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
