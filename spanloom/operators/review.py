"""Steps around a person's review: chosen rows, language gate, libraries of projects, prompts, caches of proposals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import prompt_excerpt
from spanloom.operators.spans import clamped, usable_span
from spanloom.plans.lineage import cut


def chosen_clips(finals: DataFrame, review: DataFrame, durations: DataFrame) -> DataFrame:
    """The clips that a review selects, with its times, titles and focus.

    ``finals``: source_id, index, ...; ``review``: source_id, index, start, end, selected, title, focus; ``durations``:
    source_id, duration. Times are cut to the source's duration. Raises at run time for a selected row of an unknown
    index or with times that can't be used.
    """
    rows = review.filter("selected").select("source_id", "index", F.col("start").alias("_s"), F.col("end").alias("_e"), F.coalesce("title", F.lit("")).alias("_title"), F.coalesce("focus", F.lit("largest")).alias("focus"))
    rows = rows.join(durations.select("source_id", F.col("duration").alias("_d")), "source_id", "left").join(finals.withColumn("_known", F.lit(True)), ["source_id", "index"], "left")
    bad = F.col("_known").isNull() | ~usable_span(F.col("_s"), F.col("_e"), F.coalesce(F.col("_d"), F.lit(-1.0)))
    start, end = clamped(F.col("_s"), F.col("_e"), F.col("_d"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("check the times of clip "), F.col("index").cast("string")))).otherwise(start)
    others = [c for c in finals.columns if c not in ("source_id", "index", "start", "end", "title", "focus")]
    return rows.select("source_id", "index", checked.cast("double").alias("start"), end.alias("end"), F.col("_title").alias("title"), "focus", *others)


def unsure_languages(sources: DataFrame, least: float = 0.60) -> DataFrame:
    """Sources (source_id, asked, detected, probability) whose language was to be detected and isn't sure enough."""
    return sources.filter(F.col("asked").isNull() & (F.coalesce("probability", F.lit(0.0)) < least))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def unregistered(library: DataFrame, targets: DataFrame) -> DataFrame:
    """Projects (key, snapshot, work_dir) left after those of the target paths (path) are taken out.

    A target is a project's snapshot, the folder that holds it, its working folder or a file in that.
    """
    t = targets.select("path").distinct().withColumn("_up", _folder(F.col("path")))
    # A disjunction can't be hashed; each way to match is one equality.
    ways = F.array(F.col("snapshot"), _folder(F.col("snapshot")), F.concat(F.lit("\x00"), F.col("work_dir")), F.concat(F.lit("\x01"), F.col("work_dir")))
    keys = library.select("key", F.explode(ways).alias("k")).filter("k IS NOT NULL")
    wanted = t.select(F.explode(F.array(F.col("path"), F.concat(F.lit("\x00"), F.col("path")), F.concat(F.lit("\x01"), F.col("_up")))).alias("k"))
    return library.join(keys.join(wanted, "k", "left_semi").select("key").distinct(), "key", "left_anti")


def protected_folders(folders: DataFrame, library: DataFrame, hidden: DataFrame) -> DataFrame:
    """Folders (path) that hold a project of the library (work_dir) or one taken out of it (path of its snapshot)."""
    kept = library.select(F.col("work_dir").alias("path")).unionByName(hidden.select(_folder(F.col("path")).alias("path")))
    return folders.join(kept.filter("path IS NOT NULL").distinct(), "path", "left_semi")


def prompts(candidates: DataFrame, instruction: str) -> DataFrame:
    """source_id, batch_no, prompt of batches of candidates (source_id, batch_no, place, start, end, text, contexts); a batch is small."""
    context = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 200)
    entry = F.concat(
        F.lit("["), F.col("place").cast("string"), F.format_string("] start=%.2f end=%.2f\n", "start", "end"), F.lit("text: "), prompt_excerpt("text"),
        F.lit("\nbefore: "), context("context_before"), F.lit("\nafter: "), context("context_after"), F.lit("\n"),
    )
    rows = candidates.select("source_id", "batch_no", F.struct("place", entry.alias("t")).alias("x")).groupBy("source_id", "batch_no").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("source_id", "batch_no", F.concat(F.array_join(F.transform("x", lambda x: x["t"]), "\n"), F.lit("\n" + instruction)).alias("prompt"))


def proposals_with_cache(chunks: DataFrame, cached: DataFrame, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """source_id, first, last, answer of all chunks (source_id, first, last, text): cached ones as they are, the others asked for.

    The answers asked for are written to the checkpoint folder, so that a later failure asks no chunk twice.
    """
    keys = ["source_id", "first", "last"]
    new = cut(propose(chunks.join(cached.select(*keys), keys, "left_anti")).select(*keys, "answer"))
    return chunks.select(*keys).join(cached.select(*keys, "answer").unionByName(new), keys)


def before_failures(answers: DataFrame, most: int = 2) -> DataFrame:
    """Answers (source_id, chunk_no, ok, ...) up to the point where ``most`` chunks of a source failed one after the other.

    Neighbours are met by equality on chunk_no, so no source is ordered as a whole.
    """
    failed = answers.filter(~F.coalesce("ok", F.lit(False))).select("source_id", F.explode(F.sequence(F.col("chunk_no"), F.col("chunk_no") + most - 1)).alias("at"))
    stops = failed.groupBy("source_id", "at").agg(F.count("*").alias("n")).filter(F.col("n") == most).groupBy("source_id").agg(F.min("at").alias("_stop"))
    return answers.join(stops, "source_id", "left").filter(F.col("_stop").isNull() | (F.col("chunk_no") <= F.col("_stop"))).drop("_stop")


def most_frequent(counts: DataFrame, most: int = 5) -> DataFrame:
    """rule, hits of the rules that changed the most, and the number of all changes in column total."""
    total = counts.agg(F.sum("hits").alias("n"))
    rows = counts.orderBy(F.desc("hits"), "rule").limit(most)
    return rows.withColumn("total", F.lit(total.first()["n"]))
