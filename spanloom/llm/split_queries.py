"""Queries that cut oversized segments and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.split import Limits, split_items
from spanloom.sources.tables import latest_by, table

#: The statement of the problem fixes the lengths; the overlap is ours.
LIMITS = {"segment": Limits(1_200, 120), "candidate": Limits(2_400, 240)}
WORDS = "array<struct<start: double, end: double, text: string>>"


def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid version of each segment: trimmed text, and its words where the text is over the limit."""
    text = F.trim("text")
    long = F.length(text) > LIMITS["segment"].longest
    rows = table(spark, sf_dir, "segments").select("source_id", "seg_idx", text.alias("text"), F.when(long, F.col("words")).alias("words"), "written_at")
    return latest_by(rows, ["source_id", "seg_idx"], ["text", "words"])


def segment_items(segments: DataFrame) -> DataFrame:
    return segments.select(F.lit("segment").alias("item_kind"), "source_id", F.col("seg_idx").alias("item_no"), "text", F.lit(None).cast("array<int>").alias("parts"), "words")


def candidate_items(spark: SparkSession, sf_dir: str, segments: DataFrame) -> DataFrame:
    """Of each candidate: the texts of its distinct listed segments in ascending order, and their sizes with the blank after each."""
    listed = latest_by(table(spark, sf_dir, "candidates"), ["cand_id"], ["source_id", "segment_indices"])
    listed = listed.select("cand_id", "source_id", F.explode(F.array_distinct("segment_indices")).alias("seg_idx"))
    texts = segments.filter(F.length("text") > 0).select("source_id", "seg_idx", "text")
    joined = listed.join(texts, ["source_id", "seg_idx"])
    rows = joined.groupBy("cand_id", "source_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    sizes = F.transform("t", lambda x: F.length(x["text"]) + 1)
    rows = rows.withColumn("text", text)
    over = F.length("text") > LIMITS["candidate"].longest
    parts = F.when(over, sizes)
    return rows.select(F.lit("candidate").alias("item_kind"), "source_id", F.col("cand_id").alias("item_no"), "text", parts.alias("parts"), F.lit(None).cast(WORDS).alias("words"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = segment_texts(spark, sf_dir)
    return segment_items(segments).unionByName(candidate_items(spark, sf_dir, segments))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all segments and candidates, those within the limit as one piece each."""
    return split_items(items(spark, sf_dir), LIMITS)


def p1_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item whether its pieces, numbered without holes, are within the limit and repeat what they should, and the
    text that they make when each is put behind the others without its overlap: that of the item."""
    p = p1_pieces(spark, sf_dir)
    limit = F.when(F.col("item_kind") == "segment", LIMITS["segment"].longest).otherwise(LIMITS["candidate"].longest)
    rows = p.withColumn("ok", (F.length("text") <= limit) & (F.length("text") == F.col("to_char") - F.col("from_char")))
    piece = F.struct("piece_no", "from_char", "to_char", "overlap", "text")
    rows = rows.groupBy("item_kind", "source_id", "item_no").agg(F.min("ok").alias("ok"), F.max("pieces").alias("n"), F.array_sort(F.collect_list(piece)).alias("p"))
    follows = F.forall(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (F.get("p", i)["piece_no"] == i) & ((i == 0) | (F.get("p", i)["from_char"] + F.get("p", i)["overlap"] == F.get("p", i - 1)["to_char"])))
    repeats = F.forall(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | F.endswith(F.get("p", i - 1)["text"], F.substring(F.get("p", i)["text"], F.lit(1), F.get("p", i)["overlap"])))
    text = F.array_join(F.transform("p", lambda x: F.substring(x["text"], x["overlap"] + 1, F.length(x["text"]))), "")
    return rows.select("item_kind", "source_id", "item_no", (F.col("ok") & (F.size("p") == F.col("n")) & follows & repeats).alias("ok"), text.alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be cut."""
    cut = p1_pieces(spark, sf_dir).filter((F.col("pieces") > 1) & (F.col("piece_no") == 0))
    return cut.select("item_kind", "source_id", "item_no")


ITEMS = """
WITH segs AS (
  SELECT source_id, seg_idx, trim(text, ' ') AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, seg_idx ORDER BY written_at DESC NULLS LAST, text DESC NULLS LAST) AS k FROM segments) WHERE k = 1),
cands AS (
  SELECT cand_id, source_id, segment_indices FROM (
    SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY written_at DESC NULLS LAST, source_id DESC) AS k FROM candidates) WHERE k = 1),
listed AS (SELECT DISTINCT cand_id, source_id, unnest(segment_indices) AS seg_idx FROM cands),
joined AS (
  SELECT cand_id, l.source_id, string_agg(text, ' ' ORDER BY l.seg_idx) AS text
  FROM listed l JOIN segs s ON s.source_id = l.source_id AND s.seg_idx = l.seg_idx WHERE text <> '' GROUP BY ALL)
"""

QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rejoined": p1_rejoined}
SQL = {
    "p1_rejoined": ITEMS + """
SELECT 'segment' AS item_kind, source_id, CAST(seg_idx AS BIGINT) AS item_no, true AS ok, text FROM segs WHERE text <> ''
UNION ALL SELECT 'candidate', source_id, cand_id, true, text FROM joined""",
    "p1_found": ITEMS + """
SELECT 'segment' AS item_kind, source_id, CAST(seg_idx AS BIGINT) AS item_no FROM segs WHERE length(text) > 1200
UNION ALL SELECT 'candidate', source_id, cand_id FROM joined WHERE length(text) > 2400""",
}
