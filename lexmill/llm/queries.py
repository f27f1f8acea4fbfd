"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.decontaminate import contamination
from lexmill.llm.edit_counts import counts_after
from lexmill.llm.knn_quality import classify
from lexmill.llm.link_trust import filter_urls
from lexmill.llm.link_trust import sql as link_trust_sql
from lexmill.llm.lm_score import lm_score
from lexmill.llm.media import classes, render
from lexmill.llm.minhash import near_duplicates
from lexmill.llm.mixing import mix
from lexmill.llm.suffix_family import repeats
from lexmill.llm.token_planes import token_planes

#: Seeds of the URL filter for the test tables: labels of sites.
TRUSTED = ("tionsh", "tionble", "tiontion", "ththth")
BLOCKED = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(render(_table(spark, sf_dir, "pages")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_after(_table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), TRUSTED, BLOCKED)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_media_copies": op2_media_copies,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_lm_score": op5_lm_score,
    "op6_decontamination": op6_decontamination,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_url_filter": op8_url_filter,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_planes": op10_token_planes,
}

#: The others can't be expressed in SQL at reasonable cost; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op8_url_filter": link_trust_sql(TRUSTED, BLOCKED)}
