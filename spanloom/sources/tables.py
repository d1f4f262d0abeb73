"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_by(df: DataFrame, keys: list[str], columns: list[str], version: str = "written_at") -> DataFrame:
    """One row for each value of ``keys``: ``columns`` of the row with the greatest ``version``.

    Null versions lose against any other; rows that tie on the version are ordered by their remaining columns, so the
    result doesn't depend on the order of delivery. Rows whose key is null form a key of their own. The maximum is
    combined before the shuffle, so repeated deliveries of one hot key cost one row for each map task.
    """
    best = F.max(F.struct(F.col(version).alias("_v"), *[F.col(c) for c in columns])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in columns])


def trimmed(column: str):
    """Text without leading and trailing U+0020; other blanks stay."""
    return F.trim(F.col(column))


def hashed_share(rows: DataFrame, key: str, wanted: int, total: int) -> DataFrame:
    """About twice ``wanted`` of ``total`` rows, those with the least hashes of ``key``; all where there are fewer.

    Before an ordered limit it keeps every task from sending the driver a whole sample of its own.
    """
    if total <= 2 * wanted:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(2 * wanted / total * (1 << 40)))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over two tasks a core or as many as shuffles have, whichever is more.

    For small rows on which much is computed: by their bytes alone they would be put into a few tasks.
    """
    spark = rows.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, key)
