"""A training-data pipeline over `documents`: each stage's rows are written as Parquet and read again as the next one's.

Language ID drops documents whose language is undetermined; the quality classifier drops those it predicts to be of low
quality; near-duplicates by SimHash (five-word shingles, a similarity of 0.8 or more) leave the document with the smallest id of each group; decontamination drops documents
that hold a benchmark passage; packing lays what is left into sequences of 1024 tokens. No SQL expresses the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, langid, packing, quality, similar
from larkspur.llm.common import Scratch, freeing
from larkspur.llm.queries import _tokenizer

ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text under other names, so that none meets an operator's."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"in_{c}") for c in docs.columns))


def _together(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return made.select(*(F.col(f"`{c}`" if c in ("doc_id", "text") else f"`in_{c}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language."""
    made = langid.identify(_apart(docs), _tokenizer("piece_bpe_32k.model"), docs.select("doc_id", "text", "lang"))
    return _together(made.where(F.col("lang_pred") != langid.UNKNOWN), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are predicted to be of quality 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return _together(quality.score(_apart(docs), labels).where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return _together(similar.near_duplicates(_apart(docs)).where("kept"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents without a benchmark passage."""
    made = decontam.marked(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _together(made.where("not contaminated"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences."""
    return packing.packed(docs, _tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with freeing():  # what a stage wrote for itself goes when its rows are written
            made = Scratch(stage(spark, docs, sf_dir), name).keep()
        if before:
            before.drop()
        docs, before = made.df, made
    return docs
