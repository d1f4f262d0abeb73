"""Queries that make, cap, merge and enrich candidate spans, and that choose among scored clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.planning import Band, band_plan, batch_size, capacity, full_coverage, part_plan, suggested_clips, weighted_score
from spanloom.functions.text import prompt_excerpt
from spanloom.operators.folds import budget_chunks, caption_groups
from spanloom.operators.match import alternatives, nearest_span, pending
from spanloom.operators.periods import milliseconds, sound_span
from spanloom.operators.select import accepted, covering_clips, finals, greedy_select, reject_counts
from spanloom.operators.snap import complete_parts, to_pauses, to_speech, to_word_edges
from spanloom.operators.spans import micro_pauses, speech_runs, spoken_words
from spanloom.operators.windows import anchored_windows, capped, local_priority, merged, sliding_windows, source_words, with_context, word_windows
from spanloom.plans.bases import CANDS, CLIPS, SEGS, SOUND, WORDS, candidates, clips, segments, sound_segments, strip_sql
from spanloom.plans.lineage import cut

#: Candidates that a source keeps in capped_candidates; small, so that the cap takes effect on small data too.
KEPT = 8


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of three, five and seven consecutive segments, every second one."""
    return sliding_windows(segments(spark, sf_dir, "start", "end", "text"))


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anchored_windows(segments(spark, sf_dir, "start", "end"), 20.0, 60.0)
    return rows.select("source_id", "first_idx", "last_idx", milliseconds("start").alias("start_ms"), milliseconds("end").alias("end_ms"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir, "source_id", "start", "end", "text").filter(sound_span("start", "end"))
    return rows.withColumn("ordinal", F.col("cand_id"))


def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that a small cap leaves of each source; the priority here is the length, so that it is exact."""
    rows = _ranked(spark, sf_dir)
    return capped(rows, milliseconds("end") - milliseconds("start"), KEPT).select("source_id", "cand_id")


def candidate_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir)
    return rows.select("cand_id", F.floor(local_priority(20.0, 60.0) * 1_000_000 + 0.5).cast("bigint").alias("priority_ppm"))


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and the proposals that take the place of equal ones."""
    rows = candidates(spark, sf_dir, "source_id", "start", "end", "source").filter(sound_span("start", "end")).withColumn("ordinal", F.col("cand_id")).drop("cand_id")
    semantic = F.coalesce(F.col("source") == "semantic", F.lit(False))
    both = merged(rows.filter(~semantic), rows.filter(semantic))
    return both.select("source_id", milliseconds("start").alias("start_ms"), milliseconds("end").alias("end_ms"), "ordinal", "source")


def candidate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts before and after the segments that each candidate lists."""
    rows = candidates(spark, sf_dir, "source_id", "segment_indices").filter(F.size("segment_indices") > 0)
    rows = rows.select("cand_id", "source_id", F.array_min("segment_indices").alias("first_idx"), F.array_max("segment_indices").alias("last_idx"))
    return with_context(rows, segments(spark, sf_dir, "text")).select("cand_id", "context_before", "context_after")


def word_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 to 60 seconds from every fortieth part of the words of each segment on: the long ones have any."""
    words = spoken_words(segments(spark, sf_dir, "words"))
    own = Window.partitionBy("source_id", "seg_idx").orderBy("word_idx")
    rows = words.select(F.concat_ws("#", "source_id", "seg_idx").alias("source_id"), (F.row_number().over(own) - 1).alias("word_no"), "w_start", "w_end")
    return word_windows(rows, 20.0, 60.0).select("source_id", "first_word", "last_word", milliseconds("start").alias("start_ms"), milliseconds("end").alias("end_ms"))


def source_word_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 to 60 seconds from every fortieth part of the words of each source on, across its segments."""
    words = source_words(segments(spark, sf_dir, "words")).select("source_id", "word_no", "total", "w_start", "w_end")
    return word_windows(words, 20.0, 60.0).select("source_id", "first_word", "last_word", milliseconds("start").alias("start_ms"), milliseconds("end").alias("end_ms"))


def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips(spark, sf_dir, "hook_score", "content_score", "story_score", "emotion_score", "standalone_score", "ending_score")
    return rows.select("clip_id", weighted_score().alias("weighted"))


def quality_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: how many clips each rule rejects."""
    return reject_counts(clips(spark, sf_dir, "source_id", "start", "end", "score", "text"), ["source_id"])


def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of its run whose span is nearest to each clip's, within five seconds."""
    entries = clips(spark, sf_dir, "run_id", "start", "end").filter(sound_span("start", "end"))
    entries = entries.select("run_id", F.col("clip_id").alias("entry_id"), milliseconds("start").cast("double").alias("e_start"), milliseconds("end").cast("double").alias("e_end"))
    pool = candidates(spark, sf_dir, "run_id", "start", "end").filter(sound_span("start", "end"))
    pool = pool.select("run_id", F.col("cand_id").alias("ordinal"), milliseconds("start").cast("double").alias("c_start"), milliseconds("end").cast("double").alias("c_end"))
    found = nearest_span(entries, pool, ["run_id"], 5_000.0)
    return found.select(F.col("entry_id").alias("clip_id"), F.col("ordinal").alias("cand_id"), F.col("distance").cast("bigint").alias("distance_ms"))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no scored clip of their source has the span of."""
    rows = candidates(spark, sf_dir, "source_id", "start", "end").filter(sound_span("start", "end"))
    return pending(rows, clips(spark, sf_dir, "source_id", "start", "end").filter(sound_span("start", "end"))).select("cand_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips(spark, sf_dir, "source_id", "run_id", "start", "end", "score", "text").filter(sound_span("start", "end") & F.col("score").isNotNull())
    return rows.withColumn("ordinal", F.col("clip_id"))


def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which accepted clips of a source stay without overlap or repetition; all of them are decided."""
    return greedy_select(accepted(_scored(spark, sf_dir)), target=5, longest=60.0).select("source_id", F.col("ordinal").alias("clip_id"), "kept", "conflict")


def final_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of the kept clips of each source, numbered in order of time."""
    rows = accepted(_scored(spark, sf_dir))
    kept = greedy_select(rows, target=5, longest=60.0).filter("kept").select("source_id", "ordinal", "kept_end")
    best = finals(rows.join(kept, ["source_id", "ordinal"]), 5)
    return best.select("source_id", "index", "clip_id", milliseconds("start").alias("start_ms"), milliseconds("kept_end").alias("end_ms"))


def top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finals(_scored(spark, sf_dir), 3).select("source_id", F.col("index").cast("bigint").alias("place"), "clip_id")


def alternative_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source with clips under 50: the best clip of 50 or more that none of those overlaps by more than 15 %."""
    rows = _scored(spark, sf_dir).filter(~F.isnan("score"))
    rows = rows.withColumn("start", milliseconds("start").cast("double")).withColumn("end", milliseconds("end").cast("double"))
    return alternatives(rows.filter("score < 50"), rows, bin_s=60_000.0).select("source_id", F.col("ordinal").alias("clip_id"))


def timeline_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips picked so that each source's timeline is covered."""
    ends = sound_segments(spark, sf_dir).groupBy("source_id").agg(F.max("end").alias("duration"))
    rows = _scored(spark, sf_dir).join(ends, "source_id")
    return covering_clips(rows).select("source_id", F.col("ordinal").alias("clip_id"), "place")


def snapped_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with their ends moved to word edges, then pauses, then edges of runs of speech."""
    words = cut(spoken_words(segments(spark, sf_dir, "words")))
    runs = speech_runs(words).select("source_id", (F.col("from_ms") / 1000).alias("r_start"), (F.col("to_ms") / 1000).alias("r_end"))
    ends = words.groupBy("source_id").agg(F.max("w_end").alias("duration"))
    spans = clips(spark, sf_dir, "source_id", "start", "end").filter(sound_span("start", "end")).withColumnRenamed("clip_id", "span_id").join(ends, "source_id")
    # Each step uses its input twice.
    rows = cut(to_pauses(cut(to_word_edges(spans, words, F.col("duration"))), micro_pauses(words)))
    rows = to_speech(rows, runs, F.col("duration"), 90.0)
    return rows.select(F.col("span_id").alias("clip_id"), milliseconds("start").alias("start_ms"), milliseconds("end").alias("end_ms"))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sound_segments(spark, sf_dir).groupBy("source_id").agg(F.max(milliseconds("end")).alias("ms")).withColumn("duration", F.col("ms") / 1000)


def capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: clips of a minute that fit, clips suggested, and parts of a minute that cover it."""
    d = F.col("duration")
    return _durations(spark, sf_dir).select("source_id", capacity(d, 60.0).alias("fit"), suggested_clips(d).alias("suggested"), full_coverage(d, 60.0)["count"].alias("parts"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of lengths of ten clips of 20 to 60 seconds that each source's duration allows."""
    rows = band_plan(_durations(spark, sf_dir), "duration", Band(10, 20.0, 60.0))
    return rows.select("source_id", "min_s", "max_s", "clips_that_fit", "feasible", "adapted", "stride")


def even_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of five minutes, a short rest folded into the last."""
    rows = part_plan(_durations(spark, sf_dir), "duration", length=300.0)
    return rows.select("source_id", "part_no", milliseconds("part_start").alias("start_ms"), milliseconds("part_end").alias("end_ms"))


def spoken_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of about a minute that cover each source and end at pauses or word edges where there are any."""
    words = spoken_words(segments(spark, sf_dir, "words"))
    rows = complete_parts(_durations(spark, sf_dir).select("source_id", "duration"), micro_pauses(words), words, 60.0)
    return rows.select("source_id", "part_no", milliseconds("start").alias("start_ms"), milliseconds("end").alias("end_ms"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of at most five words of each source."""
    return caption_groups(spoken_words(segments(spark, sf_dir, "words")), ["source_id"], "source_id string")


def request_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments packed into requests of at most 4,500 characters."""
    return budget_chunks(segments(spark, sf_dir, "text").withColumnRenamed("seg_idx", "place"))


def prompt_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir, "text").select("cand_id", prompt_excerpt("text").alias("excerpt"))


def llm_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: candidates for one request, by the mean size of what is sent of each."""
    size = F.length(prompt_excerpt("text")) + F.length(F.substring(F.coalesce("context_before", F.lit("")), 1, 200)) + F.length(F.substring(F.coalesce("context_after", F.lit("")), 1, 200)) + 100
    rows = candidates(spark, sf_dir, "run_id", "text", "context_before", "context_after").groupBy("run_id").agg(F.avg(size).alias("mean"))
    return rows.select("run_id", batch_size("mean", 60.0).alias("batch"))


QUERIES = {
    "sliding_windows": windows, "anchored_windows": anchored, "capped_candidates": capped_candidates, "candidate_priority": candidate_priority, "merged_candidates": merged_candidates,
    "candidate_context": candidate_context, "word_windows": word_fallback, "source_word_windows": source_word_fallback, "weighted_scores": weighted_scores, "quality_rejects": quality_rejects, "nearest_match": nearest_match,
    "resume_pending": resume_pending, "greedy_select": greedy, "final_clips": final_clips, "top3": top3, "alternative_clip": alternative_clip, "timeline_cover": timeline_cover,
    "snapped_clips": snapped_clips, "capacity": capacities, "band_plan": bands, "even_parts": even_parts, "complete_parts": spoken_parts, "caption_groups": captions,
    "budget_chunks": request_chunks, "prompt_excerpts": prompt_excerpts, "llm_batches": llm_batches,
}

_MS = lambda c, name: f"TRY_CAST(floor({c} * 1000 + 0.5) AS BIGINT) AS {name}"
_WORD_CHAR = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"
_DURATIONS = f'{SEGS}, d AS (SELECT source_id, max(TRY_CAST(floor("end" * 1000 + 0.5) AS BIGINT)) AS ms, max(TRY_CAST(floor("end" * 1000 + 0.5) AS BIGINT)) / 1000 AS duration FROM segs WHERE {SOUND} GROUP BY ALL)'
_FIT = lambda length: f"CASE WHEN duration <= 0 OR duration < {length} THEN 0::BIGINT ELSE CAST(floor((duration - {length}) / ({length} * (1::DOUBLE - 0.15::DOUBLE))) AS BIGINT) + 1 END"
_EXCERPT = "CASE WHEN length(t) <= 1200 THEN t ELSE substr(t, 1, 850) || ' [...] ' || right(t, 350) END"
SQL = {
    "sliding_windows": f"""WITH {SEGS}, sized AS (SELECT source_id, seg_idx AS first_idx, start, unnest([3, 5, 7]) AS size FROM segs WHERE seg_idx % 2 = 0 AND seg_idx >= 0)
SELECT w.source_id, first_idx, CAST(first_idx + size - 1 AS INTEGER) AS last_idx, any_value(w.start) AS start, max_by(g."end", g.seg_idx) AS "end",
  coalesce(string_agg(trim(g.text, ' '), ' ' ORDER BY g.seg_idx) FILTER (trim(g.text, ' ') <> ''), '') AS text
FROM sized w JOIN segs g ON g.source_id = w.source_id AND g.seg_idx BETWEEN first_idx AND first_idx + size - 1
GROUP BY w.source_id, first_idx, size HAVING count(*) = size""",
    "anchored_windows": f"""WITH {SEGS}, g AS (SELECT source_id, seg_idx, start, "end" FROM segs WHERE {SOUND}),
met AS (
  SELECT a.source_id, a.seg_idx AS first_idx, b.seg_idx AS last_idx, a.start, b."end",
    max(b."end") OVER (PARTITION BY a.source_id, a.seg_idx ORDER BY b.seg_idx) - a.start AS reach
  FROM g a JOIN g b ON a.source_id = b.source_id AND b.seg_idx >= a.seg_idx WHERE a.seg_idx % 2 = 0)
SELECT source_id, first_idx, last_idx, {_MS('start', 'start_ms')}, {_MS('"end"', 'end_ms')} FROM met WHERE reach <= 90 AND "end" - start >= 20""",
    "capped_candidates": f"""WITH {CANDS}, c AS (SELECT source_id, cand_id, start, "end", TRY_CAST(floor("end" * 1000 + 0.5) AS BIGINT) - TRY_CAST(floor(start * 1000 + 0.5) AS BIGINT) AS p FROM cands WHERE {SOUND}),
n AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n, CASE WHEN max("end") OVER (PARTITION BY source_id) > 0 THEN max("end") OVER (PARTITION BY source_id) ELSE 1 END AS span FROM c),
parts AS (SELECT *, row_number() OVER (PARTITION BY source_id, greatest(0, least({KEPT - 1}, CAST(floor(start / span * {KEPT}) AS INTEGER))) ORDER BY p DESC, start, cand_id) AS r FROM n),
rest AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY p DESC, start, cand_id) AS q FROM parts WHERE n > {KEPT} AND r > 1),
picked AS (SELECT source_id, count(*) AS k FROM parts WHERE n > {KEPT} AND r = 1 GROUP BY ALL)
SELECT source_id, cand_id FROM parts WHERE n <= {KEPT} OR r = 1 UNION ALL SELECT rest.source_id, cand_id FROM rest JOIN picked USING (source_id) WHERE q <= {KEPT} - k""",
    "candidate_priority": f"""WITH {CANDS}, c AS (SELECT *, greatest(1e-6::DOUBLE, "end" - start) AS len_, len(regexp_extract_all(coalesce(text, ''), '[^\t-\r ]+')) AS n FROM cands WHERE {SOUND})
SELECT cand_id, CAST(floor((0.5::DOUBLE * (1::DOUBLE - least(1::DOUBLE, abs(len_ - 40::DOUBLE) / 40::DOUBLE)) + 0.25::DOUBLE * CASE WHEN regexp_matches(coalesce(text, ''), '[.!?؟…][\t-\r ]*$') THEN 1::DOUBLE ELSE 0.5::DOUBLE END
  + 0.25::DOUBLE * least(1::DOUBLE, n / len_ / 2.5::DOUBLE) + 0::DOUBLE) * 1000000 + 0.5::DOUBLE) AS BIGINT) AS priority_ppm FROM c""",
    "merged_candidates": f"""WITH {CANDS}, r AS (SELECT source_id, start, "end", cand_id, source, CASE WHEN source = 'semantic' THEN 0 ELSE 1 END AS rank FROM cands WHERE {SOUND})
SELECT source_id, {_MS('start', 'start_ms')}, {_MS('"end"', 'end_ms')}, coalesce(min(cand_id) FILTER (rank = 1), min(cand_id)) AS ordinal, arg_min(source, rank * 1000000000000 + cand_id) AS source
FROM r GROUP BY source_id, start, "end\"""",
    "candidate_context": f"""WITH {CANDS}, {SEGS}, c AS (SELECT cand_id, source_id, list_min(segment_indices) AS a, list_max(segment_indices) AS b FROM cands WHERE len(segment_indices) > 0)
SELECT cand_id, coalesce(trim(x.text, ' '), '') AS context_before, coalesce(trim(y.text, ' '), '') AS context_after
FROM c LEFT JOIN segs x ON x.source_id = c.source_id AND x.seg_idx = a - 1 LEFT JOIN segs y ON y.source_id = c.source_id AND y.seg_idx = b + 1""",
    "word_windows": f"""WITH {WORDS}, w AS (
  SELECT source_id || '#' || CAST(seg_idx AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY source_id, seg_idx ORDER BY word_idx) - 1 AS INTEGER) AS no, w_start, w_end,
    greatest(1, count(*) OVER (PARTITION BY source_id, seg_idx) // 40) AS step FROM spoken),
met AS (SELECT a.source_id, a.no AS first_word, a.w_start AS start, max(b.w_end) AS stop, arg_max(b.no, {{'e': b.w_end, 'n': b.no}}) AS last_word
  FROM w a JOIN w b ON a.source_id = b.source_id AND b.no >= a.no AND b.w_end - a.w_start <= 60 WHERE a.no % a.step = 0 GROUP BY ALL)
SELECT source_id, first_word, last_word, {_MS('start', 'start_ms')}, {_MS('stop', 'end_ms')} FROM met WHERE stop - start >= 20""",
    "weighted_scores": f"""WITH {CLIPS}
SELECT clip_id, floor((0::DOUBLE + 0.30::DOUBLE * hook_score + 0.20::DOUBLE * content_score + 0.20::DOUBLE * story_score + 0.15::DOUBLE * emotion_score + 0.10::DOUBLE * standalone_score + 0.05::DOUBLE * ending_score) * 100 + 0.5::DOUBLE) / 100 AS weighted FROM clips""",
    "band_plan": f"""WITH {_DURATIONS}, a AS (
  SELECT source_id, duration, least(60::DOUBLE, greatest(8::DOUBLE, duration / 10)) AS new, {_FIT('60::DOUBLE')} AS fit60 FROM d),
b AS (SELECT *, (fit60 < 10 OR duration / 10 < 60) AND new < 60::DOUBLE - 1e-9::DOUBLE AS changed FROM a),
c AS (SELECT *, CASE WHEN changed THEN new ELSE 60::DOUBLE END AS max_s FROM b),
e AS (SELECT *, least(20::DOUBLE, max_s) AS low, least(max_s, greatest(8::DOUBLE, max_s * 0.6::DOUBLE)) AS wide FROM c),
f AS (SELECT *, max_s - low < 1e-9::DOUBLE AND max_s > 8 AND abs(wide - low) > 1e-9::DOUBLE AS narrow, {_FIT('max_s')} AS fits FROM e)
SELECT source_id, CASE WHEN narrow THEN wide ELSE low END AS min_s, max_s, fits AS clips_that_fit, fits >= 10 AS feasible, changed OR 20 > max_s OR narrow OR fits < 10 AS adapted,
  CASE WHEN changed OR 20 > max_s OR narrow OR fits < 10 THEN 1 ELSE 2 END AS stride FROM f""",
    "quality_rejects": f"""WITH {CLIPS}, w AS (SELECT *, regexp_extract_all(lower(trim(coalesce(text, ''), ' ')), '{_WORD_CHAR}') AS words FROM clips),
f AS (SELECT *, len(list_filter(words, lambda x: x IN ('um', 'uh', 'like', 'you know', 'i mean', 'so yeah', 'اه', 'امم', 'يعني بس', 'امم يعني'))) AS fillers, len(words) AS n FROM w)
SELECT source_id, CASE WHEN NOT coalesce({SOUND}, false) THEN 'invalid_span' WHEN "end" - start < 3 THEN 'too_short' WHEN coalesce(score < 40, true) THEN 'below_threshold'
  WHEN n = 0 OR (n <= 3 AND fillers >= greatest(1, n - 1)) THEN 'filler' ELSE 'accepted' END AS reason, count(*) AS clips FROM f GROUP BY ALL""",
    "nearest_match": f"""WITH {CANDS}, {CLIPS},
e AS (SELECT run_id, clip_id, {_MS('start', 's')}, {_MS('"end"', 'e')} FROM (SELECT * FROM clips WHERE {SOUND}) x),
c AS (SELECT run_id, cand_id, {_MS('start', 's')}, {_MS('"end"', 'e')} FROM (SELECT * FROM cands WHERE {SOUND}) x),
m AS (SELECT clip_id, cand_id, abs(e.s - c.s) + abs(e.e - c.e) AS distance_ms FROM e JOIN c USING (run_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY distance_ms, cand_id) AS k FROM m WHERE distance_ms <= 5000)
SELECT clip_id, cand_id, distance_ms FROM r WHERE k = 1""",
    "resume_pending": f"""WITH {CANDS}, {CLIPS}
SELECT cand_id FROM cands c WHERE {SOUND} AND NOT EXISTS (SELECT 1 FROM clips s WHERE s.source_id = c.source_id AND CAST(s.start AS VARCHAR) <> 'nan' AND CAST(s."end" AS VARCHAR) <> 'nan' AND s."end" > s.start
  AND round(s.start, 3) = round(c.start, 3) AND round(s."end", 3) = round(c."end", 3))""",
    "top3": f"""WITH {CLIPS}, r AS (SELECT source_id, clip_id, start, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, clip_id) AS k FROM clips WHERE {SOUND} AND score IS NOT NULL)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY start, clip_id) AS place, clip_id FROM r WHERE k <= 3""",
    "alternative_clip": f"""WITH {CLIPS}, c AS (SELECT source_id, clip_id, score, {_MS('start', 's')}, {_MS('"end"', 'e')} FROM (SELECT * FROM clips WHERE {SOUND} AND CAST(score AS VARCHAR) <> 'nan') x),
ok AS (SELECT * FROM c WHERE score >= 50 AND e > s AND NOT EXISTS (SELECT 1 FROM c t WHERE t.source_id = c.source_id AND t.score < 50 AND t.e > c.s AND t.s < c.e
  AND (least(t.e, c.e) - greatest(t.s, c.s)) / least(t.e - t.s, c.e - c.s) > CAST(0.15 AS DOUBLE)))
SELECT source_id, clip_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, clip_id) AS k FROM ok) WHERE k = 1""",
    "capacity": f"""WITH {_DURATIONS}
SELECT source_id, CASE WHEN duration < 60 THEN 0 ELSE CAST(floor((duration - 60) / CAST(51 AS DOUBLE)) AS BIGINT) + 1 END AS fit,
  CAST(greatest(5, least(25, round_even(duration / 60 / 4, 0))) AS INTEGER) AS suggested, CAST(greatest(1, ceil(duration / 60 - 1e-9)) AS INTEGER) AS parts FROM d""",
    "even_parts": f"""WITH {_DURATIONS}, n AS (SELECT *, CAST(ceil(duration / 300) AS INTEGER) AS k FROM d), m AS (SELECT *, CASE WHEN k > 1 AND duration - (k - 1) * 300 < 3 THEN k - 1 ELSE k END AS parts FROM n),
p AS (SELECT *, unnest(range(0, parts)) AS part_no FROM m)
SELECT source_id, CAST(part_no AS INTEGER) AS part_no, CAST(part_no * 300000 AS BIGINT) AS start_ms, CASE WHEN part_no = parts - 1 THEN ms ELSE CAST((part_no + 1) * 300000 AS BIGINT) END AS end_ms FROM p""",
    "prompt_excerpts": f"WITH {CANDS}, x AS (SELECT cand_id, {strip_sql("coalesce(text, '')")} AS t FROM cands) SELECT cand_id, {_EXCERPT} AS excerpt FROM x",
    "llm_batches": f"""WITH {CANDS}, x AS (SELECT run_id, {strip_sql("coalesce(text, '')")} AS t, length(substr(coalesce(context_before, ''), 1, 200)) + length(substr(coalesce(context_after, ''), 1, 200)) AS c FROM cands),
m AS (SELECT run_id, avg(length({_EXCERPT}) + c + 100) AS mean FROM x GROUP BY ALL)
SELECT run_id, CAST(greatest(1, least(16, greatest(4, round_even(10000 / mean, 0)))) AS INTEGER) AS batch FROM m""",
}
