"""A session with the settings the library's plans are tuned for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the plans rely on; a cluster's own settings take precedence over these.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", app: str = "tallyloom", **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tallyloom-code-")) / "tallyloom.zip"  # served to the executors by the driver
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))
    context._tallyloom_shipped = True
