"""State tables: queue counts and transitions, liveness, eviction, reuse of results by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import fingerprint

# States of a queue item, and those that end it.
STATES, ENDED = ("pending", "running", "done", "failed", "skipped"), ("done", "failed", "skipped")


def state_counts(items: DataFrame) -> DataFrame:
    """state, items for every known state, 0 where there are none, and for any other state that occurs; null counts as pending."""
    known = items.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in STATES])).alias("state"), F.lit(0).alias("n"))
    rows = items.select(F.coalesce("state", F.lit("pending")).alias("state"), F.lit(1).alias("n"))
    return known.unionByName(rows).groupBy("state").agg(F.sum("n").cast("bigint").alias("items"))


def recovered(items: DataFrame) -> DataFrame:
    """Items that ran when the queue broke off are pending again, without an error."""
    ran = F.col("state") == "running"
    return items.withColumn("error", F.when(ran, F.lit("")).otherwise(F.col("error"))).withColumn("state", F.when(ran, F.lit("pending")).otherwise(F.col("state")))


def failures_reset(items: DataFrame) -> DataFrame:
    """Failed items are pending again, without error and end."""
    f = F.coalesce(F.col("state") == "failed", F.lit(False))
    rows = items.withColumn("error", F.when(f, F.lit("")).otherwise(F.col("error"))).withColumn("finished", F.when(~f, F.col("finished")))
    return rows.withColumn("state", F.when(f, F.lit("pending")).otherwise(F.col("state")))


def unfinished(items: DataFrame) -> DataFrame:
    return items.filter(~F.coalesce(F.col("state").isin(*ENDED), F.lit(False)))


def next_pending(items: DataFrame) -> DataFrame:
    """The pending item added first (ties by id); one row or none."""
    cols = items.columns
    best = F.min_by(F.struct(*cols), F.struct("added", "id")).alias("b")
    return items.filter(F.coalesce("state", F.lit("pending")) == "pending").agg(best).filter("b IS NOT NULL").select("b.*")


def first_by_source(items: DataFrame, source: str = "source") -> DataFrame:
    """Of items with the same source the one added first."""
    best = F.min_by(F.struct(*items.columns), F.struct("added", "id")).alias("b")
    return items.groupBy(F.col(source).alias("_k")).agg(best).select("b.*")


def duplicated_sources(items: DataFrame, source: str = "source") -> DataFrame:
    """source, items of sources that are queued more than once."""
    return items.groupBy(source).agg(F.count("*").alias("items")).filter("items > 1")


def stalled(jobs: DataFrame, now: float, limit_s: float = 20.0) -> DataFrame:
    """Running jobs without a heartbeat for ``limit_s`` (epoch seconds); one that never had any is stalled."""
    beat = F.coalesce(F.col("heartbeat"), F.lit(0.0))
    return jobs.filter((F.col("state") == "running") & (F.lit(now) - beat >= limit_s))


def expired(entries: DataFrame, now: float, ttl_s: float = 86_400.0) -> DataFrame:
    return entries.filter(F.lit(now) - F.coalesce(F.col("touched"), F.lit(0.0)) > ttl_s)


def fresh(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (source_id, fingerprint, path, size, mtime) for which an artifact with all the same values exists."""
    keys = ["source_id", "fingerprint", "path", "size", "mtime"]
    return wanted.join(artifacts.select(*keys).distinct(), keys, "left_semi")


def stale(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` that must be computed again."""
    keys = ["source_id", "fingerprint", "path", "size", "mtime"]
    return wanted.join(artifacts.select(*keys).distinct(), keys, "left_anti")


def run_fingerprint(*settings: Column | str) -> Column:
    """Fingerprint of the settings a result depends on; correction rules belong among them."""
    return fingerprint(F.lit("run-v1"), *settings)


def verdict(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """source_id, verdict of each scanned source (source_id, has_audio): review_required with any finding, degraded without audio, else clear."""
    hits = findings.groupBy("source_id").agg(F.count("*").alias("n"))
    rows = scanned.join(hits, "source_id", "left")
    kind = F.when(F.coalesce("n", F.lit(0)) > 0, "review_required").when(~F.coalesce("has_audio", F.lit(False)), "degraded").otherwise("clear")
    return rows.select("source_id", kind.alias("verdict"), F.coalesce("n", F.lit(0)).cast("bigint").alias("findings"))


def slice_findings(scores: DataFrame, kind: str, least: float, slice_s: float) -> DataFrame:
    """source_id, kind, time, score: of each slice of time the first score (source_id, time, score) that reaches ``least``."""
    rows = scores.filter(F.col("score") >= least).withColumn("_s", F.floor(F.col("time") / slice_s))
    return rows.groupBy("source_id", "_s").agg(F.min(F.struct("time", "score")).alias("b")).select("source_id", F.lit(kind).alias("kind"), "b.time", "b.score")


def run_summary(runs: DataFrame) -> DataFrame:
    """ok, sources, seconds of finished runs (source_id, ok, seconds)."""
    return runs.groupBy("ok").agg(F.count("*").alias("sources"), F.sum("seconds").alias("seconds"))


def translated(values: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """``values`` with ``column`` looked up in (key, value), kept as it is where the key is missing."""
    d = dictionary.select(F.col("key").alias(column), F.col("value").alias("_v"))
    return values.join(d, column, "left").withColumn(column, F.coalesce("_v", column)).drop("_v")
