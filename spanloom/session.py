"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings every session of this library should carry; a cluster's own values win where they are set at submit time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def session(master: str | None = None, app: str = "spanloom", **conf: str) -> SparkSession:
    """A session with DEFAULTS and ``conf`` (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the session's Python workers, once for each context.

    Workers import it by name; whether they could find it otherwise depends on where and how the driver was started.
    Only the driver reads the archive's folder; executors get the archive from the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_spanloom_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spanloom-code-")) / "spanloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, Path("spanloom") / path.relative_to(home))
    context.addPyFile(str(archive))
    context._spanloom_shipped = True
