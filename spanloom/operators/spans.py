"""Operators on time spans of sources: bins, overlap joins, runs of speech, coverage, nearest edges.

Spans carry ``source_id``, ``start`` and ``end`` in seconds unless a function names other columns. Joins on time add
an equality on time bins, so that a source of any size is spread over its bins and never compared as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.periods import milliseconds, periods_and_gaps

#: Seconds of one bin of the joins on time.
BIN_S = 60.0
#: Bins are numbered in a circle of so many, so that a span of any length is in no more.
CIRCLE = 16_384


def clamped(start: Column, end: Column, limit: Column) -> tuple[Column, Column]:
    """A span within [0, limit], its ends swapped where they are out of order."""
    a, b = F.greatest(F.lit(0.0), F.least(start, limit)), F.greatest(F.lit(0.0), F.least(end, limit))
    return F.least(a, b), F.greatest(a, b)


def usable_span(start: Column, end: Column, limit: Column, slack: float = 0.05) -> Column:
    """0 <= start < end <= limit, the last with some slack; false for nulls and NaN."""
    ok = (start >= 0) & (start < end) & (end <= limit + slack) & ~F.isnan(start) & ~F.isnan(end)
    return F.coalesce(ok, F.lit(False))


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared time by the shorter span; 0 where that has no length."""
    shared = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    shorter = F.least(a_end - a_start, b_end - b_start)
    return F.when(shorter > 0, shared / shorter).otherwise(F.lit(0.0))


def bin_of(x: Column, width: float) -> Column:
    return F.pmod(F.floor(x / width), F.lit(CIRCLE)).cast("int")


def bins_of(start: Column, end: Column, width: float) -> Column:
    """The bins of a span, each once; times a whole circle apart share one, so what meets in a bin is compared by time too."""
    number = lambda x: F.floor(x / width).cast("double")
    first, more = bin_of(start, width), F.least(number(end) - number(start), F.lit(CIRCLE - 1.0)).cast("int")
    return F.transform(F.sequence(first, first + more), lambda b: F.pmod(b, F.lit(CIRCLE)))


def timed(start: str, end: str) -> Column:
    s, e = F.col(start), F.col(end)
    return s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e) & (F.abs(s) < float("inf")) & (F.abs(e) < float("inf"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], bin_s: float = BIN_S) -> DataFrame:
    """Pairs of the same keys whose spans share time (touching is not sharing); columns of both, which must not clash.

    Each span, however long, is sent to its bins; a pair counts in the bin where the later of the two starts lies, so
    it comes once without a distinct. Spans with null, infinite or unordered ends meet nothing.
    """
    spread = lambda df, s, e: df.filter(timed(s, e) & (F.col(e) > F.col(s))).withColumn("_bin", F.explode(bins_of(F.col(s), F.col(e), bin_s)))
    right = spread(right, *r)
    right = right.select([F.col(c).alias(f"_r_{c}") if c in (*keys, "_bin") else F.col(c) for c in right.columns])
    left = spread(left, *l)
    on = left["_bin"] == right["_r__bin"]
    for k in keys:
        on = on & (left[k] == right[f"_r_{k}"])
    pairs = left.join(right, on)
    shared = (F.col(r[1]) > F.col(l[0])) & (F.col(r[0]) < F.col(l[1]))
    home = F.col("_bin") == bin_of(F.greatest(F.col(l[0]), F.col(r[0])), bin_s)
    return pairs.filter(shared & home).drop("_bin", "_r__bin", *[f"_r_{k}" for k in keys])


def spoken_words(segments: DataFrame) -> DataFrame:
    """source_id, seg_idx, word_idx, w_start, w_end, word of all timed words; blank ones and ones of no length are left out."""
    rows = segments.select("source_id", "seg_idx", F.posexplode("words").alias("word_idx", "w"))
    rows = rows.select("source_id", "seg_idx", "word_idx", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), F.trim("w.text").alias("word"))
    return rows.filter((F.col("word") != "") & (F.col("w_end") > F.col("w_start")) & ~F.isnan("w_start") & ~F.isnan("w_end"))


def speech_runs(words: DataFrame, gap_ms: int = 450) -> DataFrame:
    """source_id, from_ms, to_ms of the runs of speech; a silence of ``gap_ms`` or more parts two runs.

    Ends are moved by the gap less one millisecond and back, which turns the rule into that of touching spans; the
    period operator bounds what a task holds.
    """
    spans = words.select("source_id", milliseconds("w_start").alias("s"), (milliseconds("w_end") + (gap_ms - 1)).alias("e"))
    runs = periods_and_gaps(spans, ["source_id"], "s", "e").filter("kind = 'period'")
    return runs.select("source_id", "from_ms", (F.col("to_ms") - (gap_ms - 1)).alias("to_ms"))


def micro_pauses(words: DataFrame, least_s: float = 0.25) -> DataFrame:
    """source_id, seg_idx, moment, gap: the middle and length of silences between words of one segment."""
    w = Window.partitionBy("source_id", "seg_idx").orderBy("w_start", "w_end", "word_idx")
    rows = words.withColumn("_before", F.lag("w_end").over(w)).withColumn("gap", F.col("w_start") - F.col("_before"))
    return rows.filter(F.col("gap") >= least_s).select("source_id", "seg_idx", (F.col("_before") + F.col("gap") / 2).alias("moment"), "gap")


def coverage(spans: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, duration_ms, covered_ms, gaps, gap_ms of each entity of ``durations`` (keys, duration_ms).

    ``spans`` has keys, s, e in milliseconds and is clipped to the duration; the end of the timeline counts as a gap
    where nothing covers it. Without duration nothing is covered and there are no gaps.
    """
    d = durations.select(*keys, F.col("duration_ms").cast("long").alias("duration_ms"))
    inside = spans.join(d, keys).select(*keys, F.greatest(F.lit(0), "s").alias("s"), F.least("e", "duration_ms").alias("e")).filter("e > s")
    periods = periods_and_gaps(inside, keys, "s", "e").filter("kind = 'period'")
    sums = periods.groupBy(*keys).agg(F.sum(F.col("to_ms") - F.col("from_ms")).alias("covered_ms"), F.count("*").alias("_n"), F.min("from_ms").alias("_first"), F.max("to_ms").alias("_last"))
    rows = d.join(sums, keys, "left")
    covered = F.coalesce("covered_ms", F.lit(0))
    gaps = F.when(F.col("_n").isNull(), F.lit(1)).otherwise(F.col("_n") - 1 + (F.col("_first") > 0).cast("long") + (F.col("_last") < F.col("duration_ms")).cast("long"))
    some = F.coalesce(F.col("duration_ms") > 0, F.lit(False))
    zero = lambda c: F.when(some, c).otherwise(F.lit(0)).cast("bigint")
    return rows.select(*keys, "duration_ms", zero(covered).alias("covered_ms"), zero(gaps).alias("gaps"), zero(F.col("duration_ms") - covered).alias("gap_ms"))


def containing(points: DataFrame, spans: DataFrame, point: str, span: tuple[str, str], bin_s: float = BIN_S) -> DataFrame:
    """``points`` (source_id, ...) with the columns of the first span of the source that holds them; null where none does.

    ``points`` needs a column point_id; a span holds its start and its end.
    """
    s, e = span
    wide = spans.filter(timed(s, e) & (F.col(e) >= F.col(s))).withColumn("_bin", F.explode(bins_of(F.col(s), F.col(e), bin_s)))
    wide = wide.select(*[F.col(c).alias("_src") if c == "source_id" else F.col(c) for c in wide.columns])
    p = points.filter(timed(point, point)).withColumn("_pbin", bin_of(F.col(point), bin_s))
    found = p.join(wide, (p["source_id"] == wide["_src"]) & (p["_pbin"] == wide["_bin"]) & (wide[s] <= p[point]) & (wide[e] >= p[point]))
    best = found.groupBy("source_id", "point_id").agg(F.min(F.struct(s, e)).alias("_b")).select("source_id", "point_id", f"_b.{s}", f"_b.{e}")
    return points.join(best, ["source_id", "point_id"], "left")


def nearest_edges(points: DataFrame, spans: DataFrame, point: str, span: tuple[str, str]) -> DataFrame:
    """``points`` with prev_end, the latest end at or before each, and next_start, the earliest start at or after it.

    One ordered pass over points and edges of a source, in blocks: the last edge of each whole bin is carried from a
    summary of the bins, so that no task orders a whole source.
    """
    s, e = span
    rows = points.select("source_id", F.col(point).alias("_x"), F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_e"), F.lit(None).cast("double").alias("_s"), "point_id")
    edge = lambda c, name: spans.select("source_id", F.col(c).alias("_x"), F.lit(1).alias("_k"), (F.col(c) if name == "_e" else F.lit(None).cast("double")).alias("_e"), (F.col(c) if name == "_s" else F.lit(None).cast("double")).alias("_s"), F.lit(None).cast("long").alias("point_id"))
    rows = rows.withColumn("point_id", F.col("point_id").cast("long")).unionByName(edge(e, "_e")).unionByName(edge(s, "_s"))
    rows = rows.withColumn("_bin", F.floor(F.col("_x") / (10 * BIN_S)))
    bins = rows.groupBy("source_id", "_bin").agg(F.max("_e").alias("_me"), F.min("_s").alias("_ms"))
    over = Window.partitionBy("source_id").orderBy("_bin")
    bins = bins.select("source_id", "_bin", F.max("_me").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_pe"), F.min("_ms").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_ns"))
    own = Window.partitionBy("source_id", "_bin").orderBy("_x")
    rows = rows.withColumn("_oe", F.max("_e").over(own.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_os", F.min("_s").over(own.rangeBetween(0, Window.unboundedFollowing)))
    found = rows.filter(F.col("point_id").isNotNull()).join(bins, ["source_id", "_bin"])
    found = found.select("source_id", "point_id", F.coalesce("_oe", "_pe").alias("prev_end"), F.coalesce("_os", "_ns").alias("next_start"))
    return points.join(found, ["source_id", "point_id"], "left")


def progress_marks(segments: DataFrame, durations: DataFrame, step: int = 5, rows_step: int = 50) -> DataFrame:
    """source_id, seg_idx, percent: segments at which progress is reported: the first to reach another ``step`` percent.

    ``durations``: source_id, duration; where it isn't known (null or not positive) every ``rows_step``-th segment is
    reported, with a null percent. Steps are at most 100 / step a source, and only they are ordered.
    """
    d = durations.select("source_id", F.col("duration").alias("_d"))
    rows = segments.select("source_id", "seg_idx", "end").join(d, "source_id", "left")
    known = F.coalesce((F.col("_d") > 0) & ~F.isnan("_d"), F.lit(False))
    end = F.when(F.col("end").isNull() | F.isnan("end") | (F.abs("end") == float("inf")), F.lit(0.0)).otherwise(F.col("end"))
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), end / F.col("_d") * 100))
    steps = rows.filter(known).withColumn("percent", F.floor(percent).cast("int")).withColumn("_s", F.floor(percent / step).cast("int")).filter("_s >= 1")
    first = steps.groupBy("source_id", "_s").agg(F.min(F.struct("seg_idx", "percent")).alias("b"))
    above = Window.partitionBy("source_id").orderBy("_s").rowsBetween(1, Window.unboundedFollowing)
    first = first.withColumn("_later", F.min("b.seg_idx").over(above)).filter(F.col("_later").isNull() | (F.col("b.seg_idx") < F.col("_later")))
    marks = first.select("source_id", "b.seg_idx", "b.percent")
    other = rows.filter(~known & ((F.col("seg_idx") + 1) % rows_step == 0)).select("source_id", "seg_idx", F.lit(None).cast("int").alias("percent"))
    return marks.unionByName(other)
