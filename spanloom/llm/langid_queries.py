"""Queries on the languages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.langid import detect, fit_profiles
from spanloom.sources.tables import table


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return detect(docs, fit_profiles(docs))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each document that has several, or whose label is missing or names another one."""
    rows = detected(spark, sf_dir).filter(F.size("languages") > 0)
    wrong = (F.size("languages") > 1) | ~F.array_contains("languages", F.col("label"))
    return rows.filter(wrong).select("doc_id", F.explode("languages").alias("found_lang")).distinct()


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's main language (null without a sentence), its confidence, how many it has and what its label says."""
    rows = detected(spark, sf_dir)
    return rows.select("doc_id", "label", F.get("languages", F.lit(0)).alias("lang"), F.get("confidences", F.lit(0)).alias("confidence"), F.size("languages").alias("languages"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of one language that each document consists of."""
    return detected(spark, sf_dir).select("doc_id", F.posexplode("passages").alias("passage_no", "p")).select("doc_id", "passage_no", "p.*")


QUERIES = {"p8_found": p8_found, "p8_languages": p8_languages, "p8_passages": p8_passages}
SQL: dict[str, str] = {}
