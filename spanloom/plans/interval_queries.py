"""Queries on time: coverage, gaps, runs of speech, pauses, overlaps and nearest edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.periods import periods_and_gaps, sound_span
from spanloom.operators.spans import clamped, containing, coverage, micro_pauses, nearest_edges, overlap_join, overlap_ratio, progress_marks, speech_runs, spoken_words, usable_span
from spanloom.plans.bases import CANDS, CLIPS, MS, SEGS, SOUND, WORDS, candidates, clips, in_ms, islands_sql, segments, sound_segments


def coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: how much of its time segments cover."""
    rows = in_ms(sound_segments(spark, sf_dir)).select("source_id", "s", "e")
    return coverage(rows, rows.groupBy("source_id").agg(F.max("e").alias("duration_ms")), ["source_id"])


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_ms(sound_segments(spark, sf_dir))
    return periods_and_gaps(rows, ["source_id"], "s", "e").filter("kind = 'gap'").drop("kind")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken_words(segments(spark, sf_dir, "words"))


def activity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of speech without a silence of 0.45 seconds."""
    return speech_runs(_words(spark, sf_dir))


def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of a quarter of a second or more between words of one segment."""
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return micro_pauses(_words(spark, sf_dir)).select("source_id", "seg_idx", ms("moment").alias("moment_ms"), ms("gap").alias("gap_ms"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clips of one run that share more than 15 % of the shorter one."""
    rows = in_ms(clips(spark, sf_dir, "run_id", "start", "end").filter(sound_span("start", "end"))).select("run_id", "clip_id", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"))
    other = rows.select("run_id", F.col("clip_id").alias("clip_b"), F.col("s").alias("s_b"), F.col("e").alias("e_b"))
    met = overlap_join(rows, other, ["run_id"], ("s", "e"), ("s_b", "e_b"), 60_000.0).filter("clip_id < clip_b")
    met = met.filter(overlap_ratio(F.col("s"), F.col("e"), F.col("s_b"), F.col("e_b")) > 0.15)
    shared = F.least("e", "e_b") - F.greatest("s", "s_b")
    return met.select("run_id", F.col("clip_id").alias("clip_a"), "clip_b", shared.cast("bigint").alias("shared_ms"))


def words_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words spoken during each clip."""
    rows = clips(spark, sf_dir, "source_id", "start", "end").filter(sound_span("start", "end"))
    met = overlap_join(rows, _words(spark, sf_dir).select("source_id", "w_start", "w_end"), ["source_id"], ("start", "end"), ("w_start", "w_end"))
    return met.groupBy("clip_id").agg(F.count("*").alias("words"))


def containing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of speech in which each clip starts, if there is one."""
    runs = speech_runs(_words(spark, sf_dir)).select("source_id", F.col("from_ms").cast("double").alias("from_ms"), F.col("to_ms").cast("double").alias("to_ms"))
    points = in_ms(clips(spark, sf_dir, "source_id", "start", "end").filter(sound_span("start", "end"))).select("source_id", F.col("clip_id").alias("point_id"), F.col("s").cast("double").alias("s"))
    found = containing(points, runs, "s", ("from_ms", "to_ms"), 60_000.0)
    return found.select(F.col("point_id").alias("clip_id"), F.col("from_ms").cast("bigint").alias("from_ms"), F.col("to_ms").cast("bigint").alias("to_ms"))


def nearest_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each clip's start: where the last segment before ended and where the next begins."""
    spans = sound_segments(spark, sf_dir).select("source_id", "start", "end")
    points = clips(spark, sf_dir, "source_id", "start", "end").filter(sound_span("start", "end")).select("source_id", F.col("clip_id").alias("point_id"), F.col("start").alias("x"))
    return nearest_edges(points, spans, "x", ("start", "end")).select(F.col("point_id").alias("clip_id"), "prev_end", "next_start")


def clamp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates within their source's duration, and whether they were usable as they stood."""
    ends = sound_segments(spark, sf_dir).groupBy("source_id").agg(F.max("end").alias("d"))
    rows = candidates(spark, sf_dir, "source_id", "start", "end").filter(F.col("start").isNotNull() & F.col("end").isNotNull() & ~F.isnan("start") & ~F.isnan("end")).join(ends, "source_id")
    a, b = clamped(F.col("start"), F.col("end"), F.col("d"))
    return rows.select("cand_id", a.alias("start_s"), b.alias("end_s"), usable_span(F.col("start"), F.col("end"), F.col("d")).alias("usable"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each source that are the first to reach another five percent of its time."""
    rows = segments(spark, sf_dir, "end")
    ends = sound_segments(spark, sf_dir).groupBy("source_id").agg(F.max("end").alias("duration"))
    return progress_marks(rows, ends)


QUERIES = {
    "coverage_by_source": coverage_by_source, "coverage_gaps": coverage_gaps, "activity_runs": activity_runs, "micro_pauses": pauses, "overlap_pairs": overlap_pairs,
    "words_in_span": words_in_span, "containing_run": containing_run, "nearest_edges": nearest_speech, "clamp_spans": clamp_spans, "progress_marks": progress,
}
_SPANS = f"WITH {SEGS}, spans AS (SELECT source_id, {MS} FROM segs WHERE {SOUND}), {islands_sql('spans', 'source_id')}"
_RUNS = f"""WITH {WORDS}, moved AS (
  SELECT source_id, CAST(floor(w_start * 1000 + 0.5) AS BIGINT) AS s, CAST(floor(w_end * 1000 + 0.5) AS BIGINT) + 449 AS e FROM spoken), {islands_sql('moved', 'source_id')},
runs AS (SELECT source_id, from_ms, to_ms - 449 AS to_ms FROM periods)"""
SQL = {
    "coverage_by_source": _SPANS + """, ends AS (SELECT source_id, max(e) AS duration_ms FROM spans GROUP BY ALL)
SELECT source_id, duration_ms, CAST(sum(to_ms - from_ms) AS BIGINT) AS covered_ms,
  CAST(count(*) - 1 + CASE WHEN min(from_ms) > 0 THEN 1 ELSE 0 END AS BIGINT) AS gaps, CAST(duration_ms - sum(to_ms - from_ms) AS BIGINT) AS gap_ms
FROM periods JOIN ends USING (source_id) GROUP BY source_id, duration_ms""",
    "coverage_gaps": _SPANS + """
SELECT source_id, to_ms AS from_ms, next_ms AS to_ms FROM (SELECT *, lead(from_ms) OVER (PARTITION BY source_id ORDER BY island) AS next_ms FROM periods) WHERE next_ms IS NOT NULL""",
    "activity_runs": _RUNS + " SELECT * FROM runs",
    "micro_pauses": f"""WITH {WORDS}, gaps AS (
  SELECT *, lag(w_end) OVER (PARTITION BY source_id, seg_idx ORDER BY w_start, w_end, word_idx) AS before FROM spoken)
SELECT source_id, seg_idx, CAST(floor((before + (w_start - before) / 2) * 1000 + 0.5) AS BIGINT) AS moment_ms, CAST(floor((w_start - before) * 1000 + 0.5) AS BIGINT) AS gap_ms
FROM gaps WHERE w_start - before >= 0.25""",
    "overlap_pairs": f"""WITH {CLIPS}, c AS (SELECT run_id, clip_id, {MS} FROM clips WHERE {SOUND})
SELECT a.run_id, a.clip_id AS clip_a, b.clip_id AS clip_b, least(a.e, b.e) - greatest(a.s, b.s) AS shared_ms
FROM c a JOIN c b ON a.run_id = b.run_id AND a.clip_id < b.clip_id AND b.e > a.s AND b.s < a.e
WHERE (least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) > CAST(0.15 AS DOUBLE)""",
    "words_in_span": f"""WITH {WORDS}, {CLIPS}
SELECT clip_id, count(*) AS words FROM clips c JOIN spoken w ON c.source_id = w.source_id AND w.w_end > c.start AND w.w_start < c."end"
WHERE {SOUND} GROUP BY clip_id""",
    "containing_run": _RUNS + f""", {CLIPS}, p AS (SELECT source_id, clip_id, {MS} FROM clips WHERE {SOUND})
SELECT clip_id, from_ms, to_ms FROM p LEFT JOIN runs r ON r.source_id = p.source_id AND r.from_ms <= p.s AND r.to_ms >= p.s""",
    "nearest_edges": f"""WITH {SEGS}, {CLIPS}, p AS (SELECT source_id, clip_id, start AS x FROM clips WHERE {SOUND}), g AS (SELECT source_id, start, "end" FROM segs WHERE {SOUND})
SELECT clip_id, (SELECT max("end") FROM g WHERE g.source_id = p.source_id AND g."end" <= p.x) AS prev_end,
  (SELECT min(start) FROM g WHERE g.source_id = p.source_id AND g.start >= p.x) AS next_start FROM p""",
    "clamp_spans": f"""WITH {SEGS}, {CANDS}, d AS (SELECT source_id, max("end") AS d FROM segs WHERE {SOUND} GROUP BY ALL)
SELECT cand_id, least(greatest(0, least(start, d)), greatest(0, least("end", d))) AS start_s, greatest(greatest(0, least(start, d)), greatest(0, least("end", d))) AS end_s,
  start >= 0 AND start < "end" AND "end" <= d + CAST(0.05 AS DOUBLE) AS usable
FROM cands JOIN d USING (source_id) WHERE CAST(start AS VARCHAR) <> 'nan' AND CAST("end" AS VARCHAR) <> 'nan'""",
    "progress_marks": f"""WITH {SEGS}, d AS (SELECT source_id, max("end") AS d FROM segs WHERE {SOUND} GROUP BY ALL),
p AS (SELECT source_id, seg_idx, d, least(100, greatest(0, CASE WHEN "end" IS NULL OR CAST("end" AS VARCHAR) IN ('nan', 'inf', '-inf') THEN 0 ELSE "end" END / d * 100)) AS p FROM segs JOIN d USING (source_id)),
q AS (SELECT *, max(floor(p / 5)) OVER (PARTITION BY source_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT source_id, seg_idx, CAST(floor(p) AS INTEGER) AS percent FROM q WHERE floor(p / 5) >= 1 AND floor(p / 5) > coalesce(before, 0)
UNION ALL SELECT source_id, seg_idx, NULL FROM segs WHERE source_id NOT IN (SELECT source_id FROM d) AND (seg_idx + 1) % 50 = 0""",
}
