"""A training corpus in five stages, each written and read back before the next.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import bpe, decontaminate, jaccard, langid, quality
from caseflow.llm.common import table
from caseflow.llm.queries import vocabulary
from caseflow.sources.scratch import stage


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id, null included, is in ``ids``."""
    return docs.join(ids.select(F.col("doc_id").alias("kept_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was recognised; null texts and texts without letters go."""
    return _keep(docs, langid.identify(docs).where("lang_pred <> 'und'"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality machine accepts."""
    return _keep(docs, quality.rate(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, null before
    all. Rows go by doc_id and text: different texts stay apart whatever their ids, and
    rows alike in both are one document."""
    keyed = docs.withColumn("kept_key", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    found = jaccard.similar(keyed.select(F.col("kept_key").alias("doc_id"), "text")).where("doc_id = component_id")
    kept = keyed.join(found.select(F.col("doc_id").alias("kept_key")).distinct(), "kept_key", "left_semi")
    return kept.dropDuplicates(["kept_key"]).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item was found."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("quality", good),
    ("distinct", distinct),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]
ORACLE_SQL = None  # models, a similarity join and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
