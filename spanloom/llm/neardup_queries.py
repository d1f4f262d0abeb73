"""Queries on near-duplicate speech in candidates and scored clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.neardup import NearDuplicates, all_pairs, groups, near_duplicates
from spanloom.sources.tables import table

#: The statement of the problem fixes three-word sequences, a likeness of 0.6 and texts of 40 words or more.
WORDS, THRESHOLD, LEAST_WORDS = 3, (3, 5), 40


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key in (("candidates", "cand_id"), ("scored", "clip_id")):
        parts.append(table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.col(key).alias("id"), "text", "written_at"))
    return parts[0].unionByName(parts[1])


def found(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return near_duplicates(speech(spark, sf_dir), "tbl", "id", "text", WORDS, THRESHOLD, LEAST_WORDS, "written_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of alike records within one table, copies of one text included."""
    return all_pairs(found(spark, sf_dir)).withColumnRenamed("grp", "tbl")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts, each named by its least record id, with their likeness."""
    links = found(spark, sf_dir).links
    likeness = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return links.select(F.col("grp").alias("tbl"), "id_a", "id_b", F.round(likeness, 6).alias("likeness"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each compared record: the class of its words, how many other classes it is linked with, its group."""
    return groups(found(spark, sf_dir)).withColumnRenamed("grp", "tbl")


BASE = r"""
WITH RECURSIVE raw AS (
  SELECT 'candidates' AS tbl, cand_id AS id, text, written_at FROM candidates
  UNION ALL SELECT 'scored', clip_id, text, written_at FROM scored),
one AS (
  SELECT tbl, id, text FROM (SELECT *, row_number() OVER (PARTITION BY tbl, id ORDER BY written_at DESC NULLS LAST, text DESC NULLS LAST) AS k FROM raw)
  WHERE k = 1 AND text IS NOT NULL),
worded AS (SELECT tbl, id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM one),
classed AS (
  SELECT tbl, id, w, min(id) OVER (PARTITION BY tbl, w) AS class_id FROM worded WHERE len(w) >= 40),
grams AS (
  SELECT DISTINCT tbl, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT tbl, id, w, unnest(range(1, len(w) - 1)) AS i FROM classed WHERE id = class_id)),
sizes AS (SELECT tbl, id, count(*) AS n FROM grams GROUP BY ALL),
shared AS (
  SELECT a.tbl, a.id AS id_a, b.id AS id_b, count(*) AS o
  FROM grams a JOIN grams b ON a.tbl = b.tbl AND a.g = b.g AND a.id < b.id GROUP BY ALL),
links AS (
  SELECT s.tbl, id_a, id_b, o / (x.n + y.n - o) AS likeness
  FROM shared s JOIN sizes x ON x.tbl = s.tbl AND x.id = id_a JOIN sizes y ON y.tbl = s.tbl AND y.id = id_b
  WHERE o * 8 >= (x.n + y.n) * 3)
"""

QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p3_groups": p3_groups}
SQL = {
    "p3_found": BASE + """
SELECT a.tbl, a.id AS id_a, b.id AS id_b
FROM classed a JOIN classed b ON a.tbl = b.tbl AND a.id < b.id AND (a.class_id = b.class_id OR EXISTS (
  SELECT 1 FROM links l WHERE l.tbl = a.tbl AND l.id_a = least(a.class_id, b.class_id) AND l.id_b = greatest(a.class_id, b.class_id)))""",
    "p3_links": BASE + "SELECT tbl, id_a, id_b, round(likeness, 6) AS likeness FROM links",
    "p3_groups": BASE + """,
edges AS (SELECT tbl, id_a AS u, id_b AS v FROM links UNION ALL SELECT tbl, id_b, id_a FROM links),
walk AS (
  SELECT DISTINCT tbl, class_id AS node, class_id AS root FROM classed
  UNION SELECT w.tbl, e.v, w.root FROM walk w JOIN edges e ON e.tbl = w.tbl AND e.u = w.node),
roots AS (SELECT tbl, node, min(root) AS group_id FROM walk GROUP BY ALL),
ends AS (SELECT tbl, u, count(*) AS links FROM edges GROUP BY ALL)
SELECT c.tbl, c.id, c.class_id, coalesce(e.links, 0) AS links, r.group_id
FROM classed c JOIN roots r ON r.tbl = c.tbl AND r.node = c.class_id LEFT JOIN ends e ON e.tbl = c.tbl AND e.u = c.class_id""",
}
