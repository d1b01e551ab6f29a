"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet
and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuelake.llm.common import discard, fresh, held_out, materialize
from tissuelake.llm.jaccard import first_of_groups
from tissuelake.llm.langid import UNKNOWN, fit_profiles
from tissuelake.llm.langid import predict as predict_language
from tissuelake.llm.packing import pack_documents
from tissuelake.llm.pii import redact
from tissuelake.llm.quality import fit_quality, score_quality

#: Documents below these scores go.
LEAST_QUALITY = 0.7
LEAST_LANGUAGE = 0.4  # the least of 12,820 held-out labelled documents of check_s is 0.416; running Italian has 0.26 to 0.38
#: Ranks of a text with few letters say little: below SHORT letters this lower score decides.
LEAST_SHORT, SHORT = 0.2, 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores at LEAST_QUALITY or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", 4, 2))
    score = fresh(docs, "quality_score")
    return score_quality(docs, fit_quality(docs, labels), score_col=score).filter(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language: no letters, or far from every profile."""
    profiles = fit_profiles(docs.filter(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < SHORT
    near = (F.col(score) >= LEAST_LANGUAGE) | ((F.col(score) >= LEAST_SHORT) & short)
    return predict_language(docs, profiles, lang_col=lang, score_col=score).filter((F.col(lang) != UNKNOWN) & near).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of documents linked at Jaccard similarity 0.8: the least id's, or any of a group without ids.

    Rows without words are linked to nothing and stay.
    """
    return first_of_groups(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: SQL cannot express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
