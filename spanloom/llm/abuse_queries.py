"""Queries on abusive language in scored clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.abuse import CUT, fit_classifier, score_clips
from spanloom.sources.tables import latest_by, spread, table


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = latest_by(table(spark, sf_dir, "scored"), ["clip_id"], ["source_id", "title", "text"])
    model = fit_classifier(clips, table(spark, sf_dir, "labels"), table(spark, sf_dir, "blocklist"))
    return score_clips(spread(clips, "clip_id"), model)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips to review."""
    return scores(spark, sf_dir).filter(F.col("score") >= CUT).select("clip_id")


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip's score and the words it comes from."""
    return scores(spark, sf_dir)


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: clips, those to review, their rate and the mean score."""
    cases = F.count_if(F.col("score") >= CUT)
    rows = scores(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("clips"), cases.alias("cases"), F.round(F.avg("score"), 6).alias("mean_score"))
    return rows.withColumn("rate", F.round(F.col("cases") / F.col("clips"), 6))


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores, "p4_sources": p4_sources}
SQL: dict[str, str] = {}
