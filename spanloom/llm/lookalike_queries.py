"""Queries on the characters of segments and scored clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.lookalike import consistent_text, letter_scores, look_alike_pairs
from spanloom.plans.lineage import cut
from spanloom.sources.tables import latest_by, table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "segments").select(F.lit("segments").alias("grp"), F.col("seg_id").alias("id"), "text", "written_at")
    scored = table(spark, sf_dir, "scored").select(F.lit("scored").alias("grp"), F.col("clip_id").alias("id"), "text", "written_at")
    return segments.unionByName(scored)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within one table that read the same but are stored in different characters.

    The forms are made before the latest row of each key is taken, so that digests are shuffled and not texts.
    """
    texts = _texts(spark, sf_dir)
    stored = F.trim("text")
    shown = consistent_text(texts, F.col("text"), letter_scores(texts))
    rows = texts.select("grp", "id", "written_at", shown.alias("shown"), stored.alias("stored"))
    some = F.length("stored") > 0
    rows = rows.select("grp", "id", "written_at", F.when(some, F.md5("shown")).alias("seen"), F.when(some, F.md5("stored")).alias("kept"))
    forms = cut(latest_by(rows, ["grp", "id"], ["seen", "kept"]).filter(F.col("seen").isNotNull()))
    return look_alike_pairs(forms).withColumnRenamed("grp", "tbl")


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent text of every segment and scored clip."""
    texts = _texts(spark, sf_dir)
    rows = latest_by(texts, ["grp", "id"], ["text"])
    return rows.select(F.col("grp").alias("tbl"), "id", consistent_text(texts, F.col("text"), letter_scores(texts)).alias("text"))


QUERIES = {"p5_found": p5_found, "p5_text": p5_text}
SQL: dict[str, str] = {}
