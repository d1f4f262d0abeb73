"""Queries on the tokens of documents: their ids, and a mix of the sources by tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.mix import mix_copies, share_report, sized_documents
from spanloom.llm.tokens import decoded, encode_corpus, token_count
from spanloom.sources.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document, an empty list for empty and null text."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the ids of each document stand for: its own, and none for null text."""
    return p6_ids(spark, sf_dir).select("doc_id", decoded(spark, "ids").alias("text"))


def p6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, code points and tokens of each source."""
    docs = table(spark, sf_dir, "documents").select("source", F.length("text").alias("chars"), token_count(spark, "text").alias("tokens"))
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def _mix(spark: SparkSession, sf_dir: str):
    targets = table(spark, sf_dir, "mix_targets").select("source", "weight", "max_repeats")
    sized = sized_documents(table(spark, sf_dir, "documents"), token_count(spark, "text"))
    return (*mix_copies(sized, targets), targets)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document of a source with a target stands in the mix."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target: what there is, what is wanted and what the mix takes."""
    copies, plan, targets = _mix(spark, sf_dir)
    return share_report(copies, targets, plan)


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source in the mix: its documents, whether none is used more often than it may be, and whether the source
    has the tokens it should have but for one document."""
    copies, plan, targets = _mix(spark, sf_dir)
    report = share_report(copies, targets, plan).filter("docs > 0")
    largest = copies.groupBy("source").agg(F.max("n_tokens").alias("most"))
    near = F.abs(F.col("taken_tokens") - F.col("wanted_tokens")) <= F.col("most")
    return report.join(largest, "source").select("source", "docs", (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), near.alias("near"))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_kept": p7_kept, "p6_sources": p6_sources, "p7_mix": p7_mix, "p7_shares": p7_shares}
SQL = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_kept": """WITH t AS (SELECT source FROM mix_targets WHERE weight > 0 AND max_repeats > 0 GROUP BY ALL),
d AS (SELECT doc_id, arg_max(source, added_at) AS source, max(length(text)) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT source, count(*) AS docs, true AS capped, true AS near FROM d JOIN t USING (source) GROUP BY source HAVING max(n) > 0""",
}
