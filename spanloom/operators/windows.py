"""Candidate spans over a source's segments: sliding and anchored windows, caps, context, batches.

Segments carry source_id, seg_idx (a row's place in its source), start, end, text. Nothing here orders a whole source
in one task: neighbours are met by equality on seg_idx, and time by bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import ends_sentence
from spanloom.operators.periods import sound_span
from spanloom.operators.spans import bin_of, bins_of, timed


def joined_text(rows: Column) -> Column:
    """Texts of (ordinal, text) structs in order, trimmed, without empty ones, joined by blanks."""
    texts = F.transform(F.array_sort(rows), lambda x: F.trim(x["text"]))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def _homes(starts: Column, size: int) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("first_idx"), F.lit(size).alias("size")))


def sliding_windows(segments: DataFrame, sizes: tuple[int, ...] = (3, 5, 7), stride: int = 2) -> DataFrame:
    """source_id, first_idx, last_idx, start, end, text of all full windows of ``sizes`` rows, one every ``stride`` rows.

    A window is full if the source has every index in it. Each segment goes to the windows that hold it, at most
    sum(sizes) / stride + len(sizes) of them, and a window is put together from its few rows.
    """
    homes = []
    for size in sizes:
        first = (F.floor(F.greatest(F.lit(0), F.col("seg_idx") - (size - 1) + (stride - 1)) / stride) * stride).cast("int")
        starts = F.when(first <= F.col("seg_idx"), F.sequence(first, F.col("seg_idx"), F.lit(stride))).otherwise(F.array().cast("array<int>"))
        homes.append(_homes(starts, size))
    rows = segments.filter(F.col("seg_idx") >= 0).withColumn("_w", F.explode(F.concat(*homes)))
    windows = rows.groupBy("source_id", F.col("_w.first_idx").alias("first_idx"), F.col("_w.size").alias("size")).agg(
        F.count("*").alias("_n"), F.min_by("start", "seg_idx").alias("start"), F.max_by("end", "seg_idx").alias("end"),
        joined_text(F.collect_list(F.struct("seg_idx", "text"))).alias("text"),
    )
    windows = windows.filter(F.col("_n") == F.col("size"))
    return windows.select("source_id", "first_idx", (F.col("first_idx") + F.col("size") - 1).alias("last_idx"), "start", "end", "text")


def _stops(rows: DataFrame, width: float, block: int = 1_024) -> DataFrame:
    """source_id, stop_idx, s_end, _bin: rows that end bins later than one that comes after them, in the bins between.

    Only such a row can end the windows of an anchor although rows behind it still end near the anchor. The least bin
    of the rows behind is summed up for each block of indices, so that no task orders a whole source.
    """
    number = F.floor(F.col("end") / width).cast("double")
    after = (1, Window.unboundedFollowing)
    rows = rows.select("source_id", "seg_idx", "end", number.alias("_n"), F.floor(F.col("seg_idx") / block).alias("_block"))
    blocks = rows.groupBy("source_id", "_block").agg(F.min("_n").alias("_m"))
    blocks = blocks.select("source_id", "_block", F.min("_m").over(Window.partitionBy("source_id").orderBy("_block").rowsBetween(*after)).alias("_far"))
    near = F.min("_n").over(Window.partitionBy("source_id", "_block").orderBy("seg_idx").rowsBetween(*after))
    rows = rows.withColumn("_near", near).join(blocks, ["source_id", "_block"]).withColumn("_least", F.least("_near", "_far"))
    rows = rows.filter(F.col("_least") < F.col("_n"))
    # The anchor's own bin is that of its start, one bin or more before the end of the row behind.
    return rows.select("source_id", F.col("seg_idx").alias("stop_idx"), F.col("end").alias("s_end"), F.explode(bins_of((F.col("_least") - 1) * width, F.col("end"), width)).alias("_bin"))


def _banded(anchors: DataFrame, bands: DataFrame | None, shortest: float, longest: float) -> DataFrame:
    """``anchors`` with _lo and _hi: the band of their source, or that for all."""
    if bands is None:
        return anchors.withColumns({"_lo": F.lit(float(shortest)), "_hi": F.lit(float(longest))})
    own = bands.select("source_id", F.col("min_s").alias("_lo"), F.least(F.col("max_s"), F.lit(float(longest))).alias("_hi"))
    return anchors.join(own, "source_id")


def anchored_windows(segments: DataFrame, shortest: float, longest: float, stride: int = 2, bands: DataFrame | None = None) -> DataFrame:
    """source_id, first_idx, last_idx, start, end: from every ``stride``-th row on, each reach of ``shortest`` to 1.5 x ``longest`` seconds.

    A window ends before the first row whose end is more than 1.5 x longest after the anchor's start, wherever that is.
    Anchors meet the rows that end in the time bin of their start or the next one; rows that end later count where rows
    behind them end earlier again (see _stops). Rows without a sound span are passed over. ``bands`` (source_id, min_s,
    max_s) has the lengths of single sources, none longer than ``longest``; sources without one have no windows then.
    """
    most = 1.5 * longest
    sound = segments.filter(sound_span("start", "end") & timed("start", "end")).select("source_id", "seg_idx", "start", "end")
    anchors = sound.filter(F.col("seg_idx") % stride == 0).select("source_id", F.col("seg_idx").alias("first_idx"), F.col("start").alias("a_start"))
    anchors = _banded(anchors, bands, shortest, longest)
    met = anchors.withColumn("_bin", F.explode(bins_of(F.col("a_start"), F.col("a_start") + most, most))).join(sound.withColumn("_bin", bin_of(F.col("end"), most)), ["source_id", "_bin"])
    length = F.col("end") - F.col("a_start")
    met = met.filter((F.col("seg_idx") >= F.col("first_idx")) & (length > 0) & (length <= 2 * most))
    w = Window.partitionBy("source_id", "first_idx").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_reach", F.max("end").over(w) - F.col("a_start")).filter((F.col("_reach") <= 1.5 * F.col("_hi")) & (length >= F.col("_lo")))
    met = met.select("source_id", "first_idx", F.col("seg_idx").alias("last_idx"), F.col("a_start").alias("start"), "end")
    ended = anchors.withColumn("_bin", bin_of(F.col("a_start"), most)).join(_stops(sound, most), ["source_id", "_bin"])
    ended = ended.filter((F.col("stop_idx") >= F.col("first_idx")) & (F.col("s_end") - F.col("a_start") > 1.5 * F.col("_hi")))
    ended = ended.groupBy("source_id", "first_idx").agg(F.min("stop_idx").alias("_stop"))
    met = met.join(ended, ["source_id", "first_idx"], "left").filter(F.col("_stop").isNull() | (F.col("last_idx") < F.col("_stop")))
    return met.drop("_stop")


def local_priority(shortest: float | Column, longest: float | Column, proposed: Column | None = None) -> Column:
    """Rank of a window (start, end, text) before any score: near the middle of the band, ending a sentence, dense."""
    target = (F.lit(shortest) + F.lit(longest)) / 2
    length = F.greatest(F.lit(1e-6), F.col("end") - F.col("start"))
    fit = 1 - F.least(F.lit(1.0), F.abs(length - target) / F.greatest(target, F.lit(1.0)))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda x: x != ""))
    dense = F.least(F.lit(1.0), words / length / 2.5)
    bonus = F.lit(0.0) if proposed is None else F.when(proposed, F.lit(0.2)).otherwise(F.lit(0.0))
    return 0.5 * fit + 0.25 * F.when(ends_sentence("text"), F.lit(1.0)).otherwise(F.lit(0.5)) + 0.25 * dense + bonus


def capped(candidates: DataFrame, priority: Column, most: int = 600) -> DataFrame:
    """At most ``most`` candidates of each source, spread over its timeline.

    The timeline falls into ``most`` equal parts; the best of each stays (priority, then earlier start, then ordinal),
    and the best of the rest fill up. Sources that have few enough keep all. ``candidates`` needs ordinal. Ranks are
    taken per part of a source, and of the rest only the best ``most`` are ordered, so a hot source is spread.
    """
    spans = candidates.groupBy("source_id").agg(F.max("end").alias("_span"), F.count("*").alias("_n"))
    rows = candidates.withColumn("_p", priority).join(spans, "source_id")
    span = F.when(F.col("_span") > 0, F.col("_span")).otherwise(F.lit(1.0))
    rows = rows.withColumn("_part", F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor(F.col("start") / span * most).cast("int"))))
    best = [F.desc("_p"), F.asc("start"), F.asc("ordinal")]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("source_id", "_part").orderBy(*best)))
    few = F.col("_n") <= most
    first = rows.filter(few | (F.col("_r") == 1))
    picked = first.filter(~few).groupBy("source_id").agg(F.count("*").alias("_k"))
    rest = rows.filter(~few & (F.col("_r") > 1)).withColumn("_q", F.row_number().over(Window.partitionBy("source_id").orderBy(*best)))
    rest = rest.filter(F.col("_q") <= most).join(picked, "source_id").filter(F.col("_q") <= most - F.col("_k")).drop("_q", "_k")
    return first.unionByName(rest).drop("_p", "_span", "_n", "_part", "_r")


def merged(windows: DataFrame, proposals: DataFrame) -> DataFrame:
    """Windows and proposals by (source_id, start, end); a proposal takes the place, and the ordinal, of an equal window."""
    both = windows.withColumn("_rank", F.lit(1)).unionByName(proposals.withColumn("_rank", F.lit(0)))
    keys = ["source_id", "start", "end"]
    rest = [c for c in both.columns if c not in (*keys, "_rank", "ordinal")]
    best = F.min(F.struct("_rank", F.col("ordinal").alias("_o"), *rest)).alias("_b")
    place = F.coalesce(F.min(F.when(F.col("_rank") == 1, F.col("ordinal"))), F.min("ordinal")).alias("ordinal")
    return both.groupBy(*keys).agg(best, place).select(*keys, "ordinal", *[F.col(f"_b.{c}").alias(c) for c in rest])


def with_context(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """``candidates`` (source_id, first_idx, last_idx, ...) with context_before and context_after, the texts next to them."""
    texts = segments.select("source_id", "seg_idx", F.trim("text").alias("_t"))
    side = lambda by, name: texts.select("source_id", (F.col("seg_idx") + (1 if name == "context_before" else -1)).alias(by), F.col("_t").alias(name))
    rows = candidates.join(side("first_idx", "context_before"), ["source_id", "first_idx"], "left").join(side("last_idx", "context_after"), ["source_id", "last_idx"], "left")
    return rows.withColumn("context_before", F.coalesce("context_before", F.lit(""))).withColumn("context_after", F.coalesce("context_after", F.lit("")))


def numbered_words(words: DataFrame, block: int = 1_024) -> DataFrame:
    """``words`` (source_id, seg_idx, word_idx, ...) with word_no, a word's place in its source from 0.

    Numbers are summed over the words of a segment, the segments of a block and the blocks of a source, so that no task
    orders all words, or all segments, of a source.
    """
    before = (Window.unboundedPreceding, -1)
    counts = words.groupBy("source_id", "seg_idx").agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col("seg_idx") / block))
    blocks = counts.groupBy("source_id", "_b").agg(F.sum("_n").alias("_m"))
    blocks = blocks.select("source_id", "_b", F.coalesce(F.sum("_m").over(Window.partitionBy("source_id").orderBy("_b").rowsBetween(*before)), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum("_n").over(Window.partitionBy("source_id", "_b").orderBy("seg_idx").rowsBetween(*before)), F.lit(0))
    starts = counts.withColumn("_own", own).join(blocks, ["source_id", "_b"]).select("source_id", "seg_idx", (F.col("_base") + F.col("_own")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("source_id", "seg_idx").orderBy("word_idx")) - 1
    return words.withColumn("_place", place).join(starts, ["source_id", "seg_idx"]).withColumn("word_no", (F.col("_start") + F.col("_place")).cast("long")).drop("_place", "_start")


def source_words(segments: DataFrame, block: int = 1_024) -> DataFrame:
    """source_id, seg_idx, word_no, total, w_start, w_end, word: timed words of segments (one row for each source_id and
    seg_idx) with their places in the source from 0 and their number there.

    Places are summed over segments and blocks of segments before the words are taken apart, so no word is shuffled.
    Blank words and ones without a sound span are left out before.
    """
    sound = lambda w: (F.trim(w["text"]) != "") & (w["end"] > w["start"]) & ~F.isnan(w["start"]) & ~F.isnan(w["end"])
    rows = segments.select("source_id", "seg_idx", F.filter("words", sound).alias("_w")).filter(F.size("_w") > 0)
    counts = rows.select("source_id", "seg_idx", F.size("_w").alias("_n"), F.floor(F.col("seg_idx") / block).alias("_b"))
    before = (Window.unboundedPreceding, -1)
    over = Window.partitionBy("source_id").orderBy("_b")
    sums = counts.groupBy("source_id", "_b").agg(F.sum("_n").alias("_m"))
    sums = sums.select("source_id", "_b", F.sum("_m").over(over.rowsBetween(*before)).alias("_far"), F.sum("_m").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    near = F.sum("_n").over(Window.partitionBy("source_id", "_b").orderBy("seg_idx").rowsBetween(*before))
    starts = counts.withColumn("_near", near).join(sums, ["source_id", "_b"])
    starts = starts.select("source_id", "seg_idx", (F.coalesce("_far", F.lit(0)) + F.coalesce("_near", F.lit(0))).alias("_start"), "total")
    rows = rows.join(starts, ["source_id", "seg_idx"]).select("source_id", "seg_idx", "_start", "total", F.posexplode("_w").alias("_place", "_x"))
    return rows.select("source_id", "seg_idx", (F.col("_start") + F.col("_place")).alias("word_no"), "total", F.col("_x.start").alias("w_start"), F.col("_x.end").alias("w_end"), F.trim("_x.text").alias("word"))


def word_windows(words: DataFrame, shortest: float, longest: float, bands: DataFrame | None = None) -> DataFrame:
    """source_id, first_word, last_word, start, end: from anchors a fortieth of the words apart, the longest chunk in the band.

    ``words`` has source_id, word_no (place in the source), w_start, w_end and, where it is known, total, how many words
    the source has; ``bands`` as for anchored_windows.
    """
    bin_ = lambda c: F.floor(F.col(c) / longest).cast("long")
    anchors = words if "total" in words.columns else words.join(words.groupBy("source_id").agg(F.count("*").alias("total")), "source_id")
    anchors = anchors.filter(F.col("word_no") % F.greatest(F.lit(1), F.floor(F.col("total") / 40)) == 0)
    anchors = _banded(anchors, bands, shortest, longest)
    anchors = anchors.select(F.col("source_id").alias("_s"), "_lo", "_hi", F.col("word_no").alias("first_word"), F.col("w_start").alias("start"), F.explode(F.array(bin_("w_start"), bin_("w_start") + 1)).alias("_b"))
    rows = words.select("source_id", "word_no", "w_end", bin_("w_end").alias("_bin"))
    met = anchors.join(rows, (anchors["_s"] == rows["source_id"]) & (anchors["_b"] == rows["_bin"]) & (rows["word_no"] >= anchors["first_word"]) & (rows["w_end"] - anchors["start"] <= anchors["_hi"]))
    best = met.groupBy("source_id", "first_word", "start", "_lo").agg(F.max(F.struct(F.col("w_end").alias("end"), F.col("word_no").alias("last_word"))).alias("b"))
    rows = best.select("source_id", "first_word", "b.last_word", "start", "b.end", "_lo")
    return rows.filter(F.col("end") - F.col("start") >= F.col("_lo")).drop("_lo")


def batches(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """``rows`` with batch_no and place: ``size`` rows of an entity at a time, in order of a place from 0 without holes."""
    return rows.withColumn("batch_no", F.floor(F.col(order) / size).cast("int")).withColumn("place", (F.col(order) % size).cast("int"))
