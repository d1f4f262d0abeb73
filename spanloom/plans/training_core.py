"""Queries of the general training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.periods import milliseconds, periods_and_gaps, sound_span
from spanloom.sources.tables import latest_by, table


def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound spans of candidates and scored clips, one for each key, in whole milliseconds."""
    parts = []
    for name, key in (("candidates", "cand_id"), ("scored", "clip_id")):
        rows = latest_by(table(spark, sf_dir, name), [key], ["source_id", "run_id", "start", "end"])
        parts.append(rows.select(F.lit(name).alias("tbl"), "source_id", "run_id", "start", "end"))
    both = parts[0].unionByName(parts[1]).filter(sound_span("start", "end"))
    return both.select("tbl", "source_id", "run_id", milliseconds("start").alias("s"), milliseconds("end").alias("e"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(run_spans(spark, sf_dir), ["tbl", "source_id", "run_id"], "s", "e")


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: periods, covered time, gaps and the time in them."""
    found = p2_found(spark, sf_dir).withColumn("ms", F.col("to_ms") - F.col("from_ms"))
    period = F.col("kind") == "period"
    return found.groupBy("tbl", "source_id", "run_id").agg(
        F.count_if(period).alias("periods"),
        F.sum(F.when(period, F.col("ms")).otherwise(F.lit(0))).alias("covered_ms"),
        F.count_if(~period).alias("gaps"),
        F.sum(F.when(period, F.lit(0)).otherwise(F.col("ms"))).alias("gap_ms"),
    )


P2_ROWS = """
WITH raw AS (
  SELECT 'candidates' AS tbl, cand_id AS id, source_id, run_id, start, "end" AS stop, written_at FROM candidates
  UNION ALL
  SELECT 'scored', clip_id, source_id, run_id, start, "end", written_at FROM scored),
one AS (
  SELECT tbl, source_id, run_id, TRY_CAST(floor(start * 1000 + 0.5) AS BIGINT) AS s, TRY_CAST(floor(stop * 1000 + 0.5) AS BIGINT) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY tbl, id ORDER BY written_at DESC NULLS LAST, source_id DESC, run_id DESC) AS n FROM raw)
  WHERE n = 1 AND CAST(start AS VARCHAR) <> 'nan' AND CAST(stop AS VARCHAR) <> 'nan' AND stop > start),
seen AS (
  SELECT *, max(e) OVER (PARTITION BY tbl, source_id, run_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM one),
labelled AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
    OVER (PARTITION BY tbl, source_id, run_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen),
periods AS (
  SELECT tbl, source_id, run_id, island, min(s) AS from_ms, max(e) AS to_ms FROM labelled GROUP BY ALL),
found AS (
  SELECT tbl, source_id, run_id, 'period' AS kind, from_ms, to_ms FROM periods
  UNION ALL
  SELECT tbl, source_id, run_id, 'gap', to_ms, next_ms FROM (
    SELECT *, lead(from_ms) OVER (PARTITION BY tbl, source_id, run_id ORDER BY island) AS next_ms FROM periods)
  WHERE next_ms IS NOT NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage}
SQL = {
    "p2_found": P2_ROWS + "SELECT * FROM found",
    "p2_coverage": P2_ROWS + """
SELECT tbl, source_id, run_id, count(*) FILTER (kind = 'period') AS periods,
  CAST(sum(CASE WHEN kind = 'period' THEN to_ms - from_ms ELSE 0 END) AS BIGINT) AS covered_ms,
  count(*) FILTER (kind = 'gap') AS gaps,
  CAST(sum(CASE WHEN kind = 'gap' THEN to_ms - from_ms ELSE 0 END) AS BIGINT) AS gap_ms
FROM found GROUP BY ALL""",
}
