"""Structured Streaming variants of batch operators: an extension without counterpart in a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.plans.lineage import cut


def coverage_windows(spans: DataFrame, time: str, window: str = "10 minutes", late: str | None = "30 minutes") -> DataFrame:
    """source_id, window, spans, spoken_s of a stream of spans (source_id, start, end and event time); later rows are dropped.

    ``late`` None: the stream has its watermark already.
    """
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    spans = spans.withWatermark(time, late) if late else spans
    return spans.groupBy("source_id", F.window(time, window)).agg(F.count("*").alias("spans"), F.sum(length).alias("spoken_s"))


def first_deliveries(rows: DataFrame, keys: list[str], time: str, late: str = "30 minutes") -> DataFrame:
    """A stream without repeated deliveries of a key within the time that rows may be late."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def score_batches(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Scores a stream of candidates batch by batch and appends each batch's scores, so that a restart loses none.

    ``scorer`` is any function from candidates to scored rows. A batch that is run again replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return candidates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored_with_retries(candidates: DataFrame, scorer: Callable[[DataFrame, int], DataFrame], size: int, attempts: int = 3, depth: int = 2) -> DataFrame:
    """Rounds of scoring: what a round leaves without score is sent again, after ``attempts`` in batches of half the size.

    ``scorer`` takes candidates (source_id, ordinal, ...) and a batch size and gives scored rows with the same keys.
    Each round is an anti-join with what is scored, written to the checkpoint folder; it ends early once all is scored.
    """
    keys = ["source_id", "ordinal"]
    found, left = None, candidates
    for level in range(depth + 1):
        for _ in range(attempts if level == 0 else 1):
            new = cut(scorer(left, max(1, size >> level)).dropDuplicates(keys))
            found = new if found is None else found.unionByName(new)
            left = cut(left.join(new.select(*keys), keys, "left_anti"))
            if left.isEmpty():
                return found
    return found


def answered_in_batches(candidates: DataFrame, ask: Callable[[DataFrame, int], DataFrame], attempts: int = 3, depth: int = 2) -> DataFrame:
    """Entries of a model's answers: source_id, node, ordinal and whatever else ``ask`` gives, with the accepted ones of each batch.

    ``candidates``: source_id, ordinal, batch_no, place; ``ask`` takes those of the open batches, with node (a batch or a
    part of one), and the number of the round, and gives entries with source_id, node, ordinal. An answer is accepted if it has
    entries, and at least 60 % of a batch of four or more; the rest of an accepted batch isn't asked again. What isn't
    accepted in ``attempts`` rounds is halved, ``depth`` times at most; where both halves stay without an entry, the
    answer that had the most of the whole counts. Each round is written to the checkpoint folder.
    """
    node, keys = F.concat(F.col("batch_no").cast("string"), F.lit("/")), ["source_id", "node"]
    left = cut(candidates.withColumn("node", node))
    levels, number = [], 0
    for level in range(depth + 1):
        best, taken = None, []
        for attempt in range(attempts):
            sent = left.groupBy(*keys).agg(F.count("*").alias("_sent"))
            entries = cut(ask(left, number).withColumn("_try", F.lit(attempt)))
            number += 1
            came = entries.groupBy(*keys).agg(F.count("*").alias("_came"))
            good = came.join(sent, keys).filter((F.col("_came") > 0) & ~((F.col("_sent") >= 4) & (5 * F.col("_came") < 3 * F.col("_sent")))).select(*keys)
            taken.append(entries.join(good, keys, "left_semi"))
            poor = entries.join(good, keys, "left_anti")
            best = poor if best is None else best.unionByName(poor)
            left = cut(left.join(good, keys, "left_anti"))
            if left.isEmpty():
                break
        accepted = taken[0]
        for more in taken[1:]:
            accepted = accepted.unionByName(more)
        # Of what was never accepted, the attempt with the most entries, the first of equal ones.
        best = best.join(left.select(*keys).distinct(), keys, "left_semi")
        many = best.groupBy(*keys, "_try").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max(F.struct("_n", -F.col("_try"))).alias("_b"))
        best = best.join(many.select(*keys, (-F.col("_b.col2")).alias("_try")), [*keys, "_try"], "left_semi")
        levels.append((cut(accepted.drop("_try")), cut(best.drop("_try"))))
        if left.isEmpty() or level == depth:
            break
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
        half = F.when(place <= F.floor(F.count("*").over(Window.partitionBy(*keys)) / 2), F.lit("0")).otherwise(F.lit("1"))
        left = cut(left.withColumn("node", F.concat("node", half)))
    found = None
    for accepted, best in reversed(levels):
        if found is None:
            found = accepted.unionByName(best)
            continue
        # A node's parts are named by it and one more sign.
        parts = found.select("source_id", F.expr("substr(node, 1, length(node) - 1)").alias("node")).distinct()
        found = accepted.unionByName(best.join(parts, keys, "left_anti")).unionByName(found.withColumn("node", F.expr("substr(node, 1, length(node) - 1)")))
    return found
