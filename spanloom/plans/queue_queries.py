"""Queries on the queue of sources and on what runs leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.urls import FAILURES, failure_kind
from spanloom.operators.match import overlaid, retried
from spanloom.operators.queue import duplicated_sources, failures_reset, first_by_source, next_pending, recovered, run_fingerprint, run_summary, stale, state_counts, unfinished
from spanloom.sources.tables import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "queue_items").dropDuplicates(["id"])


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_counts(_items(spark, sf_dir))


def recovered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after a broken queue is taken up again and its failures are reset."""
    return state_counts(failures_reset(recovered(_items(spark, sf_dir))))


def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unfinished(_items(spark, sf_dir)).select("id")


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_pending(_items(spark, sf_dir).select("id", "state", "added")).select("id")


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are queued more than once."""
    return duplicated_sources(_items(spark, sf_dir), "source_id")


def kept_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of each source."""
    return first_by_source(_items(spark, sf_dir).select("id", "source_id", "added"), "source_id").select("source_id", "id")


def retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed items, with the folder and the settings of the item of their source that was done last where there is one."""
    rows = _items(spark, sf_dir).withColumn("settings_text", _settings())
    last = _done_last(rows).select("source_id", "folder", "settings_text")
    failed = rows.filter("state = 'failed'").select("id")
    return retried(rows.select("id", "source_id", "folder", "settings_text"), failed, last, ["id"], ["folder", "settings_text"], by=["source_id"])


def _settings() -> Column:
    entries = F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(entries, ",")


def _done_last(rows: DataFrame) -> DataFrame:
    """Of each source the item that was done last; ties go to the greater id."""
    best = F.max_by(F.struct(*rows.columns), F.struct("finished", "id")).alias("b")
    return rows.filter("state = 'done'").groupBy("source_id").agg(best).select("b.*")


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the folder of its source's first item where there is one, if it is done."""
    rows = _items(spark, sf_dir).select("id", "source_id", "state", "folder", "added")
    first = first_by_source(rows, "source_id").select("source_id", "folder")
    return overlaid(rows, first, ["source_id"], ["folder"], F.col("state") == "done").select("id", "folder")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).filter("state = 'failed'")
    return rows.groupBy(failure_kind("error").alias("kind")).agg(F.count("*").alias("items"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished items by success, and the whole seconds they took."""
    rows = _items(spark, sf_dir).filter(F.col("state").isin("done", "failed") & F.col("finished").isNotNull())
    runs = rows.select("source_id", (F.col("state") == "done").alias("ok"), F.floor(F.col("finished") - F.col("added")).cast("bigint").alias("seconds"))
    return run_summary(runs)


def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose settings or file differ from those of the item of their source that was done last, or that have none
    before them: results can't be used again. Length of the path and day of queueing stand for the file's size and time."""
    rows = _items(spark, sf_dir).withColumn("fingerprint", run_fingerprint(_settings())).withColumn("path", F.col("source"))
    rows = rows.withColumn("size", F.length("path")).withColumn("mtime", F.floor(F.col("added") / 86_400).cast("bigint"))
    return stale(_done_last(rows), rows).select("id")


QUERIES = {
    "state_counts": counts, "recovered_counts": recovered_counts, "open_items": open_items, "queue_head": head, "duplicate_sources": duplicates, "first_items": kept_items,
    "retry_overlay": retry, "overlay_edits": overlay, "failure_kinds": failures, "run_summary": summary, "stale_runs": stale_runs,
}
_ITEMS = "items AS (SELECT DISTINCT ON (id) * FROM queue_items)"
_KNOWN = "known AS (SELECT unnest(['pending', 'running', 'done', 'failed', 'skipped']) AS state)"
_COUNT = "SELECT coalesce(k.state, s.state) AS state, coalesce(n, 0) AS items FROM known k FULL JOIN s ON s.state = k.state"
_FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY added, id) AS k FROM items) WHERE k = 1)"
_DONE = """told AS (SELECT *, array_to_string(list_transform(list_sort(map_keys(settings)), lambda k: k || '=' || coalesce(settings[k], '')), ',') AS settings_text FROM items),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY finished DESC NULLS LAST, id DESC) AS k_ FROM told WHERE state = 'done') WHERE k_ = 1)"""
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(e, '{'|'.join(phrases)}') THEN '{kind}'" for kind, phrases in FAILURES) + " ELSE 'generic' END"
SQL = {
    "state_counts": f"WITH {_ITEMS}, {_KNOWN}, s AS (SELECT coalesce(state, 'pending') AS state, count(*) AS n FROM items GROUP BY ALL) {_COUNT}",
    "recovered_counts": f"WITH {_ITEMS}, {_KNOWN}, s AS (SELECT CASE WHEN coalesce(state, 'pending') IN ('running', 'failed') THEN 'pending' ELSE coalesce(state, 'pending') END AS state, count(*) AS n FROM items GROUP BY ALL) {_COUNT}",
    "open_items": f"WITH {_ITEMS} SELECT id FROM items WHERE coalesce(state, '') NOT IN ('done', 'failed', 'skipped')",
    "queue_head": f"WITH {_ITEMS} SELECT id FROM items WHERE coalesce(state, 'pending') = 'pending' ORDER BY added, id LIMIT 1",
    "duplicate_sources": f"WITH {_ITEMS} SELECT source_id, count(*) AS items FROM items GROUP BY source_id HAVING count(*) > 1",
    "first_items": f"WITH {_ITEMS}, {_FIRST} SELECT source_id, id FROM firsts",
    "retry_overlay": f"""WITH {_ITEMS}, {_DONE} SELECT i.id, i.source_id, coalesce(l.folder, i.folder) AS folder, coalesce(l.settings_text, i.settings_text) AS settings_text
FROM told i LEFT JOIN latest l ON l.source_id = i.source_id WHERE i.state = 'failed'""",
    "stale_runs": f"""WITH {_ITEMS}, {_DONE}, printed AS (SELECT *, left(sha256('run-v1|' || coalesce(settings_text, '')), 16) AS f, CAST(floor(added / 86400) AS BIGINT) AS day FROM told),
done AS (SELECT p.* FROM printed p JOIN latest l ON l.id = p.id)
SELECT id FROM printed p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.source_id = p.source_id AND d.f = p.f AND d.source = p.source AND d.day = p.day)""",
    "failure_kinds": f"WITH {_ITEMS}, f AS (SELECT lower(coalesce(error, '')) AS e FROM items WHERE state = 'failed') SELECT {_KIND} AS kind, count(*) AS items FROM f GROUP BY ALL",
    "overlay_edits": f"WITH {_ITEMS}, {_FIRST} SELECT i.id, CASE WHEN i.state = 'done' THEN coalesce(f.folder, i.folder) ELSE i.folder END AS folder FROM items i LEFT JOIN firsts f ON f.source_id = i.source_id",
    "run_summary": f"WITH {_ITEMS} SELECT state = 'done' AS ok, count(*) AS sources, CAST(sum(CAST(floor(finished - added) AS BIGINT)) AS BIGINT) AS seconds FROM items WHERE state IN ('done', 'failed') AND finished IS NOT NULL GROUP BY ALL",
}
