"""A pipeline from raw documents to packed training sequences, built from the training-data operators.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, language_id, ngram_join, packing, quality_cnn
from graphloom.llm.common import crc_mod, cut, free_name, table
from graphloom.llm.queries import FOLDS, GOOD, HELD_OUT

#: SQL cannot express the learned stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores GOOD or better stay."""
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    name = free_name(docs, "quality_score")
    return quality_cnn.score(docs, quality_cnn.learn(docs, labels), name=name).where(F.col(name) >= GOOD).drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that no learned language reads (UNREADABLE phrases per character or more)."""
    samples = language_id.learn(docs.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    pred, score, fit = (free_name(docs, c) for c in ("lang_pred", "lang_score", "lang_fit"))
    read = language_id.predict(docs, samples, lang_pred=pred, score=score, fit=fit)
    return read.where((F.col(pred) != "und") & (F.col(fit) < language_id.UNREADABLE)).drop(pred, score, fit)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that the n-gram join links, one of each group stays."""
    return ngram_join.keep_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' places in training sequences."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
