"""Continuous covered periods of overlapping spans and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a time slice in milliseconds. Spans are reduced to one for each start before they are ordered, so a slice
#: holds at most this many rows, however many rows its entity has.
SLICE_MS = 600_000
#: Milliseconds, before or after zero, that a whole number of 64 bits holds together with sums and differences of two.
FAR_MS = 2**61
#: Slices in a block, the unit over which the slices' own maxima are ordered.
SLICES = 1_024


def _beside(slices: DataFrame, value: Column, later: bool) -> DataFrame:
    """``_seen``: the greatest ``value`` of the entity's earlier slices or, if ``later``, the least of its later ones.

    A window orders the slices of one block; whole blocks are met in a summary, so no task holds all slices of one
    entity. ``_all`` is the greatest ``value`` of the entity.
    """
    pick = F.min if later else F.max
    frame = (1, Window.unboundedFollowing) if later else (Window.unboundedPreceding, -1)
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    over = Window.partitionBy("_k").orderBy("_block")
    blocks = slices.groupBy("_k", "_block").agg(pick(value).alias("_v"))
    blocks = blocks.select("_k", "_block", pick("_v").over(over.rowsBetween(*frame)).alias("_far"), F.max("_v").over(over.rowsBetween(*whole)).alias("_all"))
    near = pick(value).over(Window.partitionBy("_k", "_block").orderBy("_slice").rowsBetween(*frame))
    rows = slices.withColumn("_near", near).join(blocks, ["_k", "_block"])
    both = F.coalesce("_near", "_far") if later else F.greatest("_near", "_far")
    return rows.withColumn("_seen", both).drop("_near", "_far")


def periods_and_gaps(spans: DataFrame, keys: list[str], start: str, end: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """The periods that spans cover without a break, and the gaps between consecutive periods, of each entity.

    ``start`` and ``end`` are integer columns; spans that touch belong together. Result: ``keys``, ``kind`` ('period'
    or 'gap'), ``from_ms``, ``to_ms``. Spans with a null bound or that end before they start are left out; one of no
    length is a period of its own unless others cover or touch it. Null keys are an entity like any other, repeated
    rows change nothing, an empty table gives no rows, and other columns are ignored.

    Method: spans with the same start are reduced to the longest before the shuffle. Within a slice of time, in order
    of start, one that starts after the greatest end so far opens an island; an aggregate for each island gives the
    slice's own periods. The greatest end of earlier slices takes in those that start before it; each other one opens
    a period (and closes a gap), and the last of a slice lasts until the next one of a later slice is opened.
    """
    rows = spans.select(F.struct(*keys).alias("_k"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    rows = rows.filter(F.col("_s").isNotNull() & F.col("_e").isNotNull() & (F.col("_e") >= F.col("_s")))
    rows = rows.groupBy("_k", "_s").agg(F.max("_e").alias("_e"))
    rows = rows.withColumn("_slice", F.expr(f"_s div {slice_ms} - if(_s % {slice_ms} < 0, 1, 0)"))
    own = Window.partitionBy("_k", "_slice").orderBy("_s")
    reach = F.max("_e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_opens", F.coalesce(F.col("_s") > reach, F.lit(True)))
    rows = rows.withColumn("_from", F.max(F.when(F.col("_opens"), F.col("_s"))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("_k", "_slice", "_from").agg(F.max("_e").alias("_to"))
    slices = islands.groupBy("_k", "_slice").agg(F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_own"))
    slices = slices.withColumn("_block", F.expr(f"_slice div {SLICES} - if(_slice % {SLICES} < 0, 1, 0)"))

    last = lambda xs: F.array_max(F.transform(xs, lambda x: x["_to"]))
    slices = _beside(slices, last(F.col("_own")), later=False).withColumnsRenamed({"_seen": "_reach", "_all": "_end"})
    new = F.filter("_own", lambda x: F.col("_reach").isNull() | (x["_from"] > F.col("_reach")))
    taken_in = F.filter("_own", lambda x: x["_from"] <= F.col("_reach"))
    slices = slices.withColumn("_before", F.when(F.col("_reach").isNotNull(), F.greatest("_reach", last(taken_in)))).withColumn("_own", new)
    slices = _beside(slices, F.when(F.size("_own") > 0, F.col("_before")), later=True)
    many, until = F.size("_own"), F.coalesce("_seen", "_end")
    periods = F.transform("_own", lambda x, i: F.struct(F.lit("period").alias("kind"), x["_from"].alias("from_ms"), F.when(i == many - 1, until).otherwise(x["_to"]).alias("to_ms")))
    gaps = F.transform("_own", lambda x, i: F.struct(F.lit("gap").alias("kind"), F.when(i == 0, F.col("_before")).otherwise(F.get("_own", i - 1)["_to"]).alias("from_ms"), x["_from"].alias("to_ms")))
    found = slices.select("_k", F.inline(F.concat(periods, gaps))).filter(F.col("from_ms").isNotNull())
    return found.select(*[F.col("_k")[k].alias(k) for k in keys], "kind", "from_ms", "to_ms")


def milliseconds(seconds: str) -> Column:
    """Seconds as whole milliseconds, halves rounded up; times beyond FAR_MS, infinite ones too, are taken as that."""
    far = float(FAR_MS)
    return F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), F.col(seconds) * 1000 + F.lit(0.5)))).cast("long")


def sound_span(start: str, end: str) -> Column:
    """Both times present, not NaN, and the end after the start."""
    s, e = F.col(start), F.col(end)
    return F.coalesce(s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e) & (e > s), F.lit(False))
