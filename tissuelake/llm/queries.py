"""The registered queries of this subpackage: thin wrappers that run each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import token_report

    return token_report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_report

    return language_report(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import build_index, search

    return search(build_index(table(spark, sf_dir, "embeddings")))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import lm_report

    return lm_report(table(spark, sf_dir, "documents"))


def base_of_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: all but the list with the added spans."""
    return op3_pii(spark, sf_dir).drop("spans")


def rounded_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 with its sums rounded, since SQL adds in another order."""
    return op10_katz(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("base_score", "score")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language, op2_topk, op3_pii, op4_bpe, op5_quality, op6_packing, op7_warc, op8_jaccard, op9_ann, op10_katz, base_of_op3, rounded_op10)}

__all__ = ["ORACLES", "QUERIES"]
