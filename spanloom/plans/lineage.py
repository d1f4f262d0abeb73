"""Cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again, so that later steps survive a lost executor.

    The folder is the session's ``spark.checkpoint.dir`` or one set on the context before. Only a local master without
    either gets a temporary one; on a cluster its absence is an error, because a machine's own folder isn't shared.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
