"""The corpus pipeline: from raw documents to a mix of clean, distinct ones.

Each stage reads what the one before it wrote and calls one operator of flowloom.llm. All
columns of the documents pass through, also those named like helper columns; an empty
table stays empty, and null ids, null texts, empty texts and repeated rows are rows like
any other, as said for each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import common, decontam, jaccard, mixing, quality, toxicity
from flowloom.llm.queries import CATEGORIES, category_labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic. Null and empty texts are judged by the constants alone."""
    chain = toxicity.train(docs, category_labels(spark, sf_dir), CATEGORIES)
    return toxicity.reject(docs, chain, CATEGORIES)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the upper quality grade. Null and empty texts are judged by the thresholds alone."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.select(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id; of repeated rows one; rows without words all stay."""
    return jaccard.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a test item; those without words share none."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; nothing of those without words."""
    return mixing.taken_words(mixing.mix(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
]

#: SQL can express neither the trained models nor the draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each one's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
