"""Queries of the problems of text corpora (p6 to p8) over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquarry.llm import encode, mix, stuffing

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _mix(spark: SparkSession, d: str) -> mix.Mix:
    return mix.Mix(_documents(spark, d), spark.read.parquet(f"{d}/mix_targets.parquet"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.ids(_documents(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The selected documents of every mix and how often each is used."""
    return _mix(spark, d).selection()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source of every mix."""
    return _mix(spark, d).shares()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.found(_documents(spark, d))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's characters that stand in blocks without sentences, in hundredths."""
    return stuffing.scores(_documents(spark, d)).select("doc_id", F.floor(F.col("spam_share") * 100).cast("int").alias("percent"))


def p8_stages(spark: SparkSession, d: str) -> DataFrame:
    """Cases by the stage that decides them: redundancy with few ends of sentences alone, or only together with words."""
    found = stuffing.scores(_documents(spark, d)).where("spam_share > 0.5")
    return found.groupBy(F.when(F.col("redundant_share") > 0.5, "redundancy").otherwise("words").alias("stage")).agg(F.count("*").alias("documents"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (p6_ids, p7_mix, p7_shares, p8_found, p8_scores, p8_stages)}
SQL: dict[str, str] = {}
