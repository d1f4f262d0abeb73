"""Whole runs over all sources at once: highlights, and full coverage, keyed by source.

Steps that use their input several times get it from the checkpoint folder: a plan that holds it as often as it is used
would grow with every step, and a lost executor would repeat all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.planning import SHORTEST, Band, band_plan, weighted_score
from spanloom.operators.match import layered_match, pending
from spanloom.operators.periods import sound_span
from spanloom.operators.select import accepted, finals, greedy_select, kept_text, reject_counts, shortfall
from spanloom.operators.snap import complete_parts, to_pauses, to_speech, to_word_edges, with_neighbours
from spanloom.operators.spans import micro_pauses, speech_runs, spoken_words
from spanloom.operators.windows import anchored_windows, batches, capped, joined_text, local_priority, merged, sliding_windows, source_words, with_context, word_windows
from spanloom.plans.lineage import cut
from spanloom.plans.options import Options
from spanloom.sources.records import SUBSCORES

#: A scorer takes candidates and gives source_id, ordinal and the six sub-scores for those it could score.
Scorer = Callable[[DataFrame], DataFrame]


def plan_bands(segments: DataFrame, options: Options) -> DataFrame:
    """source_id, duration, min_s, max_s, stride, clips_that_fit, feasible, adapted: the lengths that each source's duration allows."""
    lo, hi = options.band
    ends = segments.filter(sound_span("start", "end")).groupBy("source_id").agg(F.max("end").alias("duration"))
    return band_plan(ends, "duration", Band(options.clips, lo, hi, options.most_overlap, options.evenly, options.stride))


def make_candidates(segments: DataFrame, options: Options, proposals: DataFrame | None = None, bands: DataFrame | None = None) -> DataFrame:
    """source_id, ordinal, start, end, text, context_before, context_after, min_s, max_s: windows and proposals, capped for each source.

    Lengths are those of each source's band (see plan_bands); windows start at every row of a source whose band was
    changed, and else at every ``stride``-th.
    """
    bands = cut(plan_bands(segments, options)) if bands is None else bands
    lo, hi = F.col("min_s"), F.col("max_s")
    limits = bands.select("source_id", "min_s", "max_s")
    length = F.col("end") - F.col("start")
    rows = None
    for stride in sorted({options.stride, max(1, options.stride // 2)}):
        own = segments.join(bands.filter(F.col("stride") == stride).select("source_id"), "source_id", "left_semi")
        made = sliding_windows(own, options.sizes, stride).join(limits, "source_id")
        made = made.filter((length >= F.greatest(F.lit(5.0), 0.5 * lo)) & (length <= 1.5 * hi)).drop("min_s", "max_s")
        made = cut(made.dropDuplicates(["source_id", "first_idx", "last_idx"]))
        made = made.unionByName(_grown(own, made, options, limits, stride))
        rows = made if rows is None else rows.unionByName(made)
    # First and last index make an ordinal that is unique in its source and the same in every run.
    rows = rows.withColumn("ordinal", F.col("first_idx").cast("long") * 1_000_000 + (F.col("last_idx") - F.col("first_idx"))).withColumn("proposed", F.lit(False))
    if proposals is not None and options.strategy == "hybrid":
        rows = merged(rows, proposals.select(*[c for c in rows.columns if c != "proposed"]).withColumn("proposed", F.lit(True)))
    rows = capped(cut(rows.join(limits, "source_id")), local_priority(lo, hi, F.col("proposed")), options.most_candidates)
    rows = cut(with_context(rows, segments))
    return rows.unionByName(_from_words(segments.join(rows.select("source_id").distinct(), "source_id", "left_anti"), options, limits), allowMissingColumns=True)


def _grown(segments: DataFrame, made: DataFrame, options: Options, limits: DataFrame, stride: int) -> DataFrame:
    """Anchored windows whose span of segments isn't ``made`` yet, with texts."""
    lo, hi = options.band
    spans = anchored_windows(segments, lo, max(hi, SHORTEST), stride, limits)
    spans = cut(spans.join(made.select("source_id", "first_idx", "last_idx"), ["source_id", "first_idx", "last_idx"], "left_anti"))
    # The segments of an anchor are met once, for all windows that grow from it.
    reach = spans.groupBy("source_id", "first_idx").agg(F.max("last_idx").alias("_to"))
    reach = reach.select("source_id", "first_idx", F.explode(F.sequence("first_idx", "_to")).alias("seg_idx"))
    said = reach.join(segments.select("source_id", "seg_idx", "text"), ["source_id", "seg_idx"])
    said = said.groupBy("source_id", "first_idx").agg(F.collect_list(F.struct("seg_idx", "text")).alias("_said"))
    text = joined_text(F.filter("_said", lambda x: x["seg_idx"] <= F.col("last_idx")))
    return spans.join(said, ["source_id", "first_idx"]).select("source_id", "first_idx", "last_idx", "start", "end", text.alias("text"))


def _from_words(segments: DataFrame, options: Options, limits: DataFrame) -> DataFrame:
    """Candidates of sources that have no windows (few or very long segments): spans of timed words within the band."""
    words = cut(source_words(segments.select("source_id", "seg_idx", "words")))
    lo, hi = options.band
    spans = word_windows(words.select("source_id", "word_no", "total", "w_start", "w_end"), lo, max(hi, SHORTEST), limits)
    said = spans.select("source_id", "first_word", F.explode(F.sequence("first_word", "last_word")).alias("word_no")).join(words.select("source_id", "word_no", "word"), ["source_id", "word_no"])
    texts = said.groupBy("source_id", "first_word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]), " ").alias("text"))
    rows = spans.join(texts, ["source_id", "first_word"]).withColumn("ordinal", F.col("first_word").cast("long"))
    return rows.join(limits, "source_id").select("source_id", "ordinal", "start", "end", "text", F.lit(True).alias("proposed"), F.lit("").alias("context_before"), F.lit("").alias("context_after"), "min_s", "max_s")


def scored_by_answers(candidates: DataFrame, answer: Callable[[DataFrame], DataFrame], size: int) -> DataFrame:
    """source_id, ordinal, the six sub-scores and method: a Scorer made of a model that answers batches of candidates.

    ``answer`` takes candidates with batch_no and place (from 0; ``size`` of a source at a time, in order of ordinal) and
    gives entries: source_id, batch_no, entry_no, e_start, e_end, echoed and the sub-scores. Entries find their candidates
    by layers (see layered_match); of several for one candidate the first counts, and what finds none has no score.
    """
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal")) - 1  # candidates of a source are capped
    asked = cut(batches(candidates.withColumn("_no", place), ["source_id"], "_no", size).drop("_no"))
    entries = cut(answer(asked))
    pool = asked.select("source_id", "ordinal", "batch_no", "place", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    found = layered_match(entries.select("source_id", "batch_no", "entry_no", "e_start", "e_end", "echoed"), pool).filter("ordinal IS NOT NULL")
    rows = entries.select("source_id", "batch_no", "entry_no", *SUBSCORES).join(found, ["source_id", "batch_no", "entry_no"])
    best = F.min(F.struct("batch_no", "entry_no", "method", *SUBSCORES)).alias("b")
    return rows.groupBy("source_id", "ordinal").agg(best).select("source_id", "ordinal", *[F.col(f"b.{c}").alias(c) for c in SUBSCORES], "b.method")


@dataclass
class Highlights:
    """clips: the result; stats: source_id, requested, final, fit and the counts of shortfall; why: its rows."""

    clips: DataFrame
    stats: DataFrame
    why: DataFrame


def find_highlights(segments: DataFrame, scorer: Scorer, options: Options, already: DataFrame | None = None, proposals: DataFrame | None = None) -> Highlights:
    """The best clips of each source in order of time (source_id, index, start, end, score, text), and why there are no more.

    Segments: source_id, seg_idx, start, end, text, words. Each source has the band of lengths that its duration allows.
    Candidates whose span was scored before (``already``: source_id, start, end and the sub-scores) aren't scored again.
    Rejection, snapping to words, pauses and speech (or widening by neighbours in sources without words), greedy
    selection with refill and trimming, and numbering follow in this order. Sources without candidates have no clips.
    """
    bands = cut(plan_bands(segments, options))
    candidates = cut(make_candidates(segments, options, proposals, bands))
    if already is None:
        scores = scorer(candidates)
    else:
        known = candidates.select("source_id", "ordinal", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))
        old = already.withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))
        fresh = scorer(pending(candidates, already))
        scores = fresh.unionByName(known.join(old, ["source_id", "start", "end"]), allowMissingColumns=True).select(*fresh.columns)
    scores = cut(scores)
    rows = candidates.join(scores, ["source_id", "ordinal"]).withColumn("score", weighted_score())
    rejected = reject_counts(rows, ["source_id"], options.least_score)
    rows = accepted(rows.select("source_id", "ordinal", "start", "end", "text", "score", "max_s"), options.least_score)
    hi = F.col("max_s")
    words = cut(spoken_words(segments))
    runs = cut(speech_runs(words)).select("source_id", (F.col("from_ms") / 1000).alias("r_start"), (F.col("to_ms") / 1000).alias("r_end"))
    spans = rows.join(bands.select("source_id", "duration"), "source_id").withColumnRenamed("ordinal", "span_id")
    spans = cut(to_word_edges(spans, words, F.col("duration")))
    spans = cut(to_pauses(spans, micro_pauses(words)))
    # Without any run of speech there is nothing to snap to, and neighbouring segments widen a span instead.
    spoken = runs.select("source_id").distinct()
    silent = with_neighbours(cut(spans.join(spoken, "source_id", "left_anti")), segments.filter(sound_span("start", "end")), hi)
    spans = to_speech(spans.join(spoken, "source_id", "left_semi"), runs, F.col("duration"), hi).unionByName(silent)
    spans = cut(spans.withColumnRenamed("span_id", "ordinal"))
    decided = cut(greedy_select(spans, options.most_overlap, options.most_alike, options.clips, hi))
    kept = decided.filter("kept").select("source_id", "ordinal", "kept_end")
    best = finals(spans.join(kept, ["source_id", "ordinal"]).withColumn("text", kept_text(hi)).withColumn("end", F.col("kept_end")), options.clips)
    clips = cut(best.select("source_id", "index", "start", "end", "score", "text"))
    stats = _stats(bands, rejected, decided, clips, candidates, scores, options)
    return Highlights(clips, stats, shortfall(stats, options.least_score, 3.0, options.most_overlap, options.most_alike))


def _stats(bands: DataFrame, rejected: DataFrame, decided: DataFrame, clips: DataFrame, candidates: DataFrame, scores: DataFrame, options: Options) -> DataFrame:
    """What shortfall reads, one row for each source."""
    of = lambda value: F.sum(F.when(F.col("reason") == value, F.col("clips"))).alias(value)
    counts = rejected.groupBy("source_id").agg(*[of(r) for r in ("below_threshold", "filler", "too_short", "invalid_span")])
    conflicts = decided.groupBy("source_id").agg(F.count_if(F.col("conflict") == "time").alias("overlapping"), F.count_if(F.col("conflict") == "text").alias("repeated"))
    made = clips.groupBy("source_id").agg(F.count("*").alias("final"))
    unmatched = candidates.select("source_id", "ordinal").join(scores.select("source_id", "ordinal"), ["source_id", "ordinal"], "left_anti").groupBy("source_id").agg(F.count("*").alias("unmatched"))
    rows = bands.select("source_id", F.lit(options.clips).alias("requested"), F.col("clips_that_fit").alias("fit"))
    for more in (made, counts, conflicts, unmatched):
        rows = rows.join(more, "source_id", "left")
    if "method" in scores.columns:
        by = lambda m: F.count_if(F.col("method") == m).alias(f"matched_by_{m}")
        rows = rows.join(scores.groupBy("source_id").agg(by("index"), by("position")), "source_id", "left")
    return rows


def select_highlights(segments: DataFrame, scorer: Scorer, options: Options, already: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """The clips of find_highlights: source_id, index, start, end, score, text."""
    return find_highlights(segments, scorer, options, already, proposals).clips


def run(segments: DataFrame, scorer: Scorer, options: Options, already: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """source_id, index, start, end, score, text: highlights or, where ``options.cover`` is set, parts that cover each source (score null, index from 1)."""
    if not options.cover:
        return select_highlights(segments, scorer, options, already, proposals)
    durations = segments.filter(sound_span("start", "end")).groupBy("source_id").agg(F.max("end").alias("duration"))
    parts = cover_completely(segments, durations, options)
    return parts.select("source_id", (F.col("part_no") + 1).alias("index"), "start", "end", F.lit(None).cast("double").alias("score"), "text")


def cover_completely(segments: DataFrame, durations: DataFrame, options: Options) -> DataFrame:
    """source_id, part_no, start, end, text: parts that cover each source (source_id, duration) without a gap, and what is said in them."""
    from spanloom.operators.spans import overlap_join

    words = cut(spoken_words(segments))
    parts = complete_parts(durations, micro_pauses(words), words, options.part_length)
    said = segments.select("source_id", "seg_idx", F.col("start").alias("s"), F.col("end").alias("e"), "text")
    parts = cut(parts)
    met = overlap_join(parts, said, ["source_id"], ("start", "end"), ("s", "e"))
    texts = met.groupBy("source_id", "part_no").agg(joined_text(F.collect_list(F.struct("seg_idx", "text"))).alias("text"))
    return parts.join(texts, ["source_id", "part_no"], "left").select("source_id", "part_no", "start", "end", F.coalesce("text", F.lit("")).alias("text"))
