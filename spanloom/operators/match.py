"""Matching scored entries to candidates, and joins between runs: resume, retry, overlay, alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that the ends of two spans may differ in all and still be the same span.
TOLERANCE_S = 5.0


def nearest_span(entries: DataFrame, candidates: DataFrame, keys: list[str], tolerance: float = TOLERANCE_S) -> DataFrame:
    """Of each entry (keys, entry_id, e_start, e_end) the candidate (keys, ordinal, c_start, c_end) with the least distance.

    Distance is the sum of both ends' differences and at most ``tolerance``; the first in order wins a tie. Entries
    without such a candidate have no row. Starts differ by at most the tolerance, so entries meet the candidates of
    three time bins.
    """
    bin_ = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    e = entries.withColumn("_b", F.explode(F.sequence(bin_("e_start") - 1, bin_("e_start") + 1)))
    c = candidates.withColumn("_b", bin_("c_start"))
    distance = F.abs(F.col("e_start") - F.col("c_start")) + F.abs(F.col("e_end") - F.col("c_end"))
    met = e.join(c, [*keys, "_b"]).withColumn("distance", distance).filter(F.col("distance") <= tolerance)
    best = F.min(F.struct("distance", "ordinal", "c_start", "c_end")).alias("b")
    return met.groupBy(*keys, "entry_id").agg(best).select(*keys, "entry_id", "b.ordinal", "b.distance", "b.c_start", "b.c_end")


def layered_match(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of each entry the ordinal of its candidate, and the layer that found it; unmatched ones have method 'dropped'.

    ``entries``: source_id, batch_no, entry_no, e_start, e_end, echoed (string). ``candidates``: source_id, ordinal,
    batch_no, place, c_start, c_end. In turn: the same span anywhere in the source; the nearest span in the batch; the
    place in the batch that the entry names; its own place, but only in a batch where no entry matched by time and as
    many came back as were sent. Where several candidates have the same span the first one counts.
    An entry without a batch is matched by its exact span only.
    """
    same = candidates.groupBy("source_id", F.col("c_start").alias("e_start"), F.col("c_end").alias("e_end")).agg(F.min("ordinal").alias("exact"))
    rows = entries.withColumn("entry_id", F.struct("batch_no", "entry_no")).join(same, ["source_id", "e_start", "e_end"], "left")
    near = nearest_span(rows.select("source_id", "batch_no", "entry_id", "e_start", "e_end"), candidates.select("source_id", "batch_no", "ordinal", "c_start", "c_end"), ["source_id", "batch_no"])
    rows = rows.join(near.select("source_id", "batch_no", "entry_id", F.col("ordinal").alias("near")), ["source_id", "batch_no", "entry_id"], "left")
    sent = candidates.groupBy("source_id", "batch_no").agg(F.count("*").alias("_sent"))
    came = rows.groupBy("source_id", "batch_no").agg(F.count("*").alias("_came"), F.count(F.coalesce("exact", "near")).alias("_timed"))
    rows = rows.join(sent, ["source_id", "batch_no"], "left").join(came, ["source_id", "batch_no"], "left")
    number = F.col("echoed").try_cast("double")
    echoed = F.when((number == F.floor(number)) & (number >= 0) & (number < F.col("_sent")), number.cast("int"))
    own = F.when((F.col("_timed") == 0) & (F.col("_came") == F.col("_sent")), F.col("entry_no").cast("int"))
    rows = rows.withColumn("_place", F.coalesce(echoed, own)).withColumn("_by", F.when(echoed.isNotNull(), "index").when(own.isNotNull(), "position"))
    at = candidates.select("source_id", "batch_no", F.col("place").alias("_place"), F.col("ordinal").alias("placed"))
    rows = rows.join(at, ["source_id", "batch_no", "_place"], "left")
    timed = F.coalesce("exact", "near")
    method = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "nearest").when(F.col("placed").isNotNull(), F.col("_by")).otherwise("dropped")
    return rows.select("source_id", "batch_no", "entry_no", F.coalesce(timed, F.col("placed")).alias("ordinal"), method.alias("method"))


def _span_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_ks", F.round("start", 3)).withColumn("_ke", F.round("end", 3))


def pending(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """Candidates whose span, to the millisecond, no scored row of their source has."""
    done = _span_key(scored).select("source_id", "_ks", "_ke").distinct()
    return _span_key(candidates).join(done, ["source_id", "_ks", "_ke"], "left_anti").select(*candidates.columns)


def alternatives(rows: DataFrame, pool: DataFrame, least_score: float = 50.0, most_overlap: float = 0.15, bin_s: float = 60.0) -> DataFrame:
    """Of each source the best of ``pool`` (source_id, ordinal, start, end, score) that no row overlaps by more than a share
    of the shorter; ties go to the first in order."""
    from spanloom.operators.spans import overlap_join, overlap_ratio

    good = pool.filter((F.col("score") >= least_score) & (F.col("end") > F.col("start")))
    taken = rows.select("source_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    met = overlap_join(good.select("source_id", "ordinal", "start", "end"), taken, ["source_id"], ("start", "end"), ("t_start", "t_end"), bin_s)
    hit = met.filter(overlap_ratio(F.col("start"), F.col("end"), F.col("t_start"), F.col("t_end")) > most_overlap).select("source_id", "ordinal").distinct()
    best = F.max_by(F.struct("ordinal", "start", "end", "score"), F.struct("score", -F.col("ordinal"))).alias("b")
    return good.join(hit, ["source_id", "ordinal"], "left_anti").groupBy("source_id").agg(best).select("source_id", "b.*")


def retried(rows: DataFrame, failed: DataFrame, edits: DataFrame, keys: list[str], columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows whose keys are in ``failed``, with the edited values of ``columns`` where there are any.

    ``edits`` has one row for each value of ``by``, the keys unless others are named; a null edit changes nothing.
    """
    by = by or keys
    e = edits.select(*by, *[F.col(c).alias(f"_e_{c}") for c in columns])
    kept = rows.join(failed.select(*keys).distinct(), keys, "left_semi").join(e, by, "left")
    return kept.select(*[F.coalesce(f"_e_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def overlaid(rows: DataFrame, edits: DataFrame, keys: list[str], columns: list[str], same: Column | None = None) -> DataFrame:
    """All rows, with the edited values of ``columns`` where an edit of their keys exists (and ``same`` holds)."""
    e = edits.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_e_{c}") for c in columns])
    joined = rows.join(e, keys, "left")
    use = F.coalesce(F.col("_hit"), F.lit(False)) & (same if same is not None else F.lit(True))
    return joined.select(*[F.when(use, F.coalesce(f"_e_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def edited_segments(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments with edited start, end and text; the words stay only where all three are as they were.

    Raises at run time where an edit ends before it starts. ``edits``: source_id, seg_idx, start, end, text.
    """
    e = edits.select("source_id", "seg_idx", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("text").alias("_t"), F.lit(True).alias("_hit"))
    rows = segments.join(e, ["source_id", "seg_idx"], "left")
    start, end, text = (F.when(F.col("_hit"), F.col(n)).otherwise(F.col(o)) for n, o in (("_s", "start"), ("_e", "end"), ("_t", "text")))
    same = F.col("_hit").isNull() | (F.col("_s").eqNullSafe(F.col("start")) & F.col("_e").eqNullSafe(F.col("end")) & F.col("_t").eqNullSafe(F.col("text")))
    checked = F.when(F.col("_hit") & (F.col("_e") < F.col("_s")), F.raise_error(F.lit("an edited segment ends before it starts"))).otherwise(end)
    others = [c for c in segments.columns if c not in ("start", "end", "text", "words")]
    return rows.select(*others, start.alias("start"), checked.alias("end"), text.alias("text"), F.when(same, F.col("words")).otherwise(F.array().cast(segments.schema["words"].dataType)).alias("words"))


def edit_faults(edits: DataFrame, durations: DataFrame) -> DataFrame:
    """source_id, seg_idx, fault of edits (source_id, seg_idx, start, end) that can't be used: 'times' where they aren't
    0 <= start < end <= duration (source_id, duration), 'order' where an earlier one starts later.

    The greatest start of each block of 1,024 indices is carried, so that no task orders a whole source.
    """
    rows = edits.join(durations.select("source_id", F.col("duration").alias("_d")), "source_id", "left").withColumn("_b", F.floor(F.col("seg_idx") / 1_024))
    before = (Window.unboundedPreceding, -1)
    blocks = rows.groupBy("source_id", "_b").agg(F.max("start").alias("_m"))
    blocks = blocks.select("source_id", "_b", F.max("_m").over(Window.partitionBy("source_id").orderBy("_b").rowsBetween(*before)).alias("_far"))
    near = F.max("start").over(Window.partitionBy("source_id", "_b").orderBy("seg_idx").rowsBetween(*before))
    rows = rows.withColumn("_near", near).join(blocks, ["source_id", "_b"])
    times = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_d")) & ~F.isnan("start") & ~F.isnan("end"), F.lit(False))
    order = F.coalesce(F.greatest("_near", "_far") > F.col("start"), F.lit(False))
    return rows.withColumn("fault", F.when(~times, "times").when(order, "order")).filter("fault IS NOT NULL").select("source_id", "seg_idx", "fault")


def distinct_names(files: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``files`` with entry_name: the first row of a name keeps it, later ones get their place in front."""
    w = Window.partitionBy(*keys, name).orderBy(order)
    again = F.row_number().over(w) > 1
    return files.withColumn("entry_name", F.when(again, F.concat(F.col(order).cast("string"), F.lit("_"), F.col(name))).otherwise(F.col(name)))
