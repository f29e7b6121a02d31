"""Corpus pipeline: quality, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of ``docs``, whatever further columns there are and however they are named. An empty
table stays empty; null ids are ids like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common, langid, packing, pii, quality, shingles

#: A document is rejected if less than this share of its letters stands in spans of its language.
LANGUAGE_SHARE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null texts and texts without words score 0 and go; repeated rows are judged alike and stay."""
    _, scorer = quality.train(docs)
    scored = quality.scored(docs, scorer, keep=tuple(docs.columns), name="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the predicted one. Text without letters (null too) or mostly mixed goes; repeated rows stay."""
    model = langid.fitted(docs)
    found = langid.predict(docs.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score"}), model, keep=tuple({"lang_pred": "__lang_pred", "score": "__score"}.get(c, c) for c in docs.columns), spans=False)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE))
    own = {"lang_pred": "__lang_pred", "score": "__score", "lang": "lang_pred"}
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Near duplicates have a Jaccard similarity of 0.8 or more of their five-word shingles; the SimHash index gives most links, prefixes
    the rest exactly. Texts without words are equal; of repeated rows one stays.
    """
    return shingles.deduplicated(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; null texts stay null, repeated rows stay."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document; null texts have the length of their end token."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("packing", packing_stage),
]

#: The hashed scorer, the language model and the shingle sets are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{k}")
    return docs
