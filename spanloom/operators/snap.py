"""Moving span ends to natural places of speech, and parting whole sources at them.

Words, pauses and runs of a source are met by time bins around each moved end, so only what is near is joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.folds import ordered_fold
from spanloom.operators.spans import BIN_S, bin_of, bins_of, timed


def _near(points: DataFrame, things: DataFrame, point: str, at: tuple[str, str], reach: float) -> DataFrame:
    """Points (source_id, ..., point) joined with what touches [point - reach, point + reach]."""
    low, high = F.col(point) - reach, F.col(point) + reach
    p = points.filter(timed(point, point)).withColumn("_b", F.explode(bins_of(low, high, BIN_S)))
    t = things.filter(timed(*at)).withColumn("_b", F.explode(bins_of(F.col(at[0]), F.col(at[1]), BIN_S)))
    # The later of the two beginnings lies in one bin, in which the pair counts.
    home = F.col("_b") == bin_of(F.greatest(low, F.col(at[0])), BIN_S)
    return p.join(t, ["source_id", "_b"]).filter((F.col(at[1]) >= low) & (F.col(at[0]) <= high) & home).drop("_b")


def _both_ends(spans: DataFrame, things: DataFrame, at: tuple[str, str], reach: float, best: dict[str, Callable]) -> DataFrame:
    """``spans`` with column "start" + "_to" and "end" + "_to": where each end goes, null where nowhere.

    ``best`` gives, for each end, an aggregate over the things near it (its place is in column _p) that meets only those
    of this end. Both ends meet the things in one join.
    """
    ends = F.array(*[F.struct(F.lit(c).alias("_end"), F.col(c).alias("_p")) for c in ("start", "end")])
    met = _near(spans.select("source_id", "span_id", F.inline(ends)), things, "_p", at, reach)
    own = lambda c: lambda x: F.when(F.col("_end") == c, x)
    found = met.groupBy("source_id", "span_id").agg(*[best[c](own(c)).alias(f"{c}_to") for c in ("start", "end")])
    return spans.join(found, ["source_id", "span_id"], "left")


def to_word_edges(spans: DataFrame, words: DataFrame, limit: Column) -> DataFrame:
    """``spans`` (source_id, span_id, start, end) with ends that lie strictly inside a word moved to the word's edge.

    A start goes to the word's start; an end to the word's end, at most ``limit``, if that is after the start. Of
    words that overlap, the one that starts last counts.
    """
    last = lambda own: F.max(own(F.when(F.col("w_start") <= F.col("_p"), F.struct("w_start", "w_end"))))
    rows = _both_ends(spans, words.select("source_id", "w_start", "w_end"), ("w_start", "w_end"), 0.0, {"start": last, "end": last})
    inside = lambda c: (F.col(f"{c}_to.w_start") < F.col(c)) & (F.col(f"{c}_to.w_end") > F.col(c))
    start = F.when(inside("start"), F.col("start_to.w_start")).otherwise(F.col("start"))
    end = F.when(inside("end"), F.least(F.col("end_to.w_end"), limit))
    return rows.withColumns({"start": start, "end": F.when(end > start, end).otherwise(F.col("end"))}).drop("start_to", "end_to")


def to_pauses(spans: DataFrame, pauses: DataFrame, most_s: float = 1.25) -> DataFrame:
    """``spans`` with each end moved to the middle of the deepest pause within ``most_s``, then the closest, then the first.

    ``pauses`` has source_id, moment, gap. The start moves if it stays half a second before the end, then the end if it
    stays half a second after the new start.
    """
    far = F.abs(F.col("moment") - F.col("_p"))
    deepest = lambda own: F.max(own(F.when((far > 1e-9) & (far <= most_s), F.struct(F.col("gap"), -far, (-F.col("moment")).alias("_m")))))
    rows = _both_ends(spans, pauses.select("source_id", "moment", "gap"), ("moment", "moment"), most_s, {"start": deepest, "end": deepest})
    to_start, to_end = -F.col("start_to._m"), -F.col("end_to._m")
    start = F.when(to_start < F.col("end") - 0.5, to_start).otherwise(F.col("start"))
    return rows.withColumns({"start": start, "end": F.when(to_end > start + 0.5, to_end).otherwise(F.col("end"))}).drop("start_to", "end_to")


def to_speech(spans: DataFrame, runs: DataFrame, limit: Column, longest: float | Column, snap_s: float = 2.5) -> DataFrame:
    """``spans`` with ends moved to edges of runs of speech (source_id, r_start, r_end) at most ``snap_s`` away.

    A start inside a run goes to the run's start, else its end; in silence to the next run's start, else the last run's
    end; an end the other way round. An end on an edge stays. A new start must be before the end, a new end after the
    start and at most ``longest`` after it and within ``limit``.
    """
    x = F.col("_p")
    holds = (F.col("r_start") <= x) & (F.col("r_end") >= x)
    edge = (F.abs(F.col("r_start") - x) <= 1e-6) | (F.abs(F.col("r_end") - x) <= 1e-6)
    near = lambda c, ok: F.when(ok & (F.abs(F.col(c) - x) <= snap_s), F.col(c))

    def moved(start: bool) -> Callable:
        def best(own: Callable) -> Column:
            inner = [F.min(own(near(c, holds))) for c in ("r_start", "r_end")]
            outer = [F.min(own(near("r_start", ~holds & (F.col("r_start") > x)))), F.max(own(near("r_end", ~holds & (F.col("r_end") < x))))]
            inside, outside = (F.coalesce(*(p if start else p[::-1])) for p in (inner, outer))
            return F.when(~F.max(own(edge)), F.when(F.max(own(holds)), inside).otherwise(outside))

        return best

    rows = _both_ends(spans, runs.select("source_id", "r_start", "r_end"), ("r_start", "r_end"), snap_s, {"start": moved(True), "end": moved(False)})
    start = F.when(F.col("start_to") < F.col("end"), F.col("start_to")).otherwise(F.col("start"))
    ok = (F.col("end_to") > start) & (F.col("end_to") <= F.least(limit, start + longest))
    return rows.withColumns({"start": start, "end": F.when(ok, F.col("end_to")).otherwise(F.col("end"))}).drop("start_to", "end_to")


def with_neighbours(spans: DataFrame, segments: DataFrame, longest: float | Column, most_gap: float = 1.5, slack: float = 3.0) -> DataFrame:
    """``spans`` widened by the segment before and after, where at most ``most_gap`` of silence lies between; for sources without words."""
    s = segments.filter(F.col("end") > F.col("start")).select("source_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    side = lambda c: spans.select("source_id", F.col("span_id").alias("point_id"), F.col(c).alias("_p"))
    before = _near(side("start"), s, "_p", ("g_start", "g_end"), most_gap).filter(F.col("g_end") <= F.col("_p"))
    before = before.groupBy("source_id", "point_id").agg(F.max_by("g_start", F.struct("g_end", "g_start")).alias("_bs")).withColumnRenamed("point_id", "span_id")
    after = _near(side("end"), s, "_p", ("g_start", "g_end"), most_gap).filter(F.col("g_start") >= F.col("_p"))
    after = after.groupBy("source_id", "point_id").agg(F.min(F.struct("g_start", "g_end")).alias("_a")).select("source_id", F.col("point_id").alias("span_id"), F.col("_a.g_end").alias("_ae"))
    rows = spans.join(before, ["source_id", "span_id"], "left").join(after, ["source_id", "span_id"], "left")
    rows = rows.withColumn("start", F.coalesce("_bs", "start"))
    return rows.withColumn("end", F.when(F.col("_ae") <= F.col("start") + longest + slack, F.col("_ae")).otherwise(F.col("end"))).drop("_bs", "_ae")


def next_edge(last: float, low: float, high: float, target: float, pauses: list[tuple[float, float]], words: list[tuple[float, float]], snap_s: float, word_snap: float) -> float:
    """The edge near ``target`` from ``low`` to ``high``: the deepest pause (moment, gap) near it, else the edge of a word that it cuts; ``last`` where it can't lie after that."""
    near = [(g, -abs(m - target), -m, m) for m, g in pauses if abs(m - target) <= snap_s and low <= m <= high]
    if near:
        at = max(near)[3]
    else:
        at = min(max(target, low), high)
        word = next(((s, e) for s, e in words if s < at < e), None)
        fits = [x for x in word if low <= x <= high and abs(x - at) <= word_snap] if word else []
        at = min(fits, key=lambda x: abs(x - at)) if fits else at
    return max(at, last)


def part_edges(duration: float, count: int, pauses: list[tuple[float, float]], words: list[tuple[float, float]], least: float = 3.0, snap_s: float = 2.5, word_snap: float = math.inf, targets: list[float] | None = None) -> list[float]:
    """Edges of consecutive parts from 0 to ``duration``, each near its even place but at a pause or word edge if it can be."""
    edges = [0.0]
    for i in range(1, count):
        at = next_edge(edges[-1], edges[-1] + least, duration - least * (count - i), targets[i - 1] if targets else i * duration / count, pauses, words, snap_s, word_snap)
        if at > edges[-1]:
            edges.append(at)
    return [*edges, duration]


class _Parts:
    """Of the places of a source in order, the parts that end there; the last part ends with the source."""

    def __init__(self, least: float, snap_s: float, word_snap: float):
        self.least, self.snap_s, self.word_snap, self.edge, self.no, self.end_ = least, snap_s, word_snap, 0.0, 0, 0.0

    def _part(self, to: float) -> list[tuple]:
        found = [(self.no, self.edge, to)]
        self.edge, self.no = to, self.no + 1
        return found

    def add(self, row) -> list[tuple]:
        self.end_ = row.duration
        if row.point_id == 0:
            self.edge = row.target
            return []
        pairs = lambda xs: [(x["a"], x["b"]) for x in xs] if xs is not None else []
        high = row.duration - self.least * (row.many - row.point_id)
        at = next_edge(self.edge, self.edge + self.least, high, row.target, pairs(row.pauses), pairs(row.words), self.snap_s, self.word_snap)
        return self._part(at) if at > self.edge else []

    def end(self) -> list[tuple]:
        return self._part(self.end_)


def complete_parts(sources: DataFrame, pauses: DataFrame, words: DataFrame, length: float, least: float = 3.0, snap_s: float = 2.5) -> DataFrame:
    """source_id, part_no, start, end: parts of about ``length`` seconds that cover each source without a gap.

    ``sources``: source_id, duration. Each edge depends on the one before, so the places of a source are gone through in
    order; only one place, with the pauses and words near it, is held at a time. Sources without a usable duration have
    no part.
    """
    if not length >= least:
        raise ValueError(f"a part needs {least:g} seconds or more")
    d = F.col("duration").cast("double")
    rows = sources.filter(d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf"))).withColumn("duration", d)
    count = F.least(F.greatest(F.lit(1), F.ceil(d / length).cast("int")), F.greatest(F.lit(1), F.floor(d / least).cast("int")))
    rows = rows.withColumn("count", count)
    places = rows.select("source_id", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("point_id"), "duration", F.col("count").alias("many"))
    places = places.withColumn("target", F.col("duration") * F.col("point_id") / F.col("many"))
    return _parted(places, pauses, words, least, snap_s, math.inf)


def snapped_parts(parts: DataFrame, pauses: DataFrame, words: DataFrame, least: float = 3.0, snap_s: float = 2.5) -> DataFrame:
    """source_id, part_no, start, end: given consecutive parts whose shared edges are moved to pauses or word edges near them.

    ``parts``: source_id, part_no, start, end, without a gap. An edge moves by at most ``snap_s``, to the deepest pause
    or else out of a word that it cuts, and stays where neither is near; parts keep ``least`` seconds. The first start
    and the last end stay. What is sent of a source is gone through as in complete_parts.
    """
    ends = parts.groupBy("source_id").agg(F.count("*").cast("int").alias("many"), F.max("end").alias("duration"), F.min("start").alias("_first"))
    places = parts.select("source_id", (F.col("part_no") + 1).alias("point_id"), F.col("end").alias("target")).join(ends, "source_id").filter("point_id < many")
    places = places.select("source_id", "point_id", "duration", "many", "target")
    places = places.unionByName(ends.select("source_id", F.lit(0).alias("point_id"), "duration", "many", F.col("_first").alias("target")))
    return _parted(places, pauses, words, least, snap_s, snap_s)


def _parted(places: DataFrame, pauses: DataFrame, words: DataFrame, least: float, snap_s: float, word_snap: float) -> DataFrame:
    """Parts of sources by their ``places`` (source_id, point_id, duration, many, target), of which the first, 0, is where the first part begins."""
    reach, keys = snap_s + least, ["source_id", "point_id"]
    inner = places.filter("point_id > 0").select(*keys, F.col("target").alias("_p"))

    def near(things: DataFrame, at: tuple[str, str], name: str) -> DataFrame:
        met = _near(inner, things, "_p", at, reach).select(*keys, F.struct(*[F.col(c).alias(n) for c, n in zip(things.columns[1:], "ab")]).alias("x"))
        return met.groupBy(*keys).agg(F.array_sort(F.collect_set("x")).alias(name))

    rows = places.join(near(pauses.select("source_id", "moment", "gap"), ("moment", "moment"), "pauses"), keys, "left")
    rows = rows.join(near(words.select("source_id", "w_start", "w_end"), ("w_start", "w_end"), "words"), keys, "left")
    return ordered_fold(rows, ["source_id"], ["point_id"], lambda: _Parts(least, snap_s, word_snap), "source_id string, part_no int, start double, end double")
