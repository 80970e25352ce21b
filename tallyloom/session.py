"""Session factory and the few settings the plans rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "tallyloom", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for local use. On a cluster the caller brings its own session; nothing here is required there."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors.

    ``spark.checkpoint.dir`` names it on a cluster. Where it is unset (local
    tests) a temporary folder is made, which is only right for one machine.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not known and not current.isEmpty():
        return current.get()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set on this cluster")
        known = tempfile.mkdtemp(prefix="tallyloom-checkpoint-")
    if current.isEmpty():
        sc.setCheckpointDir(known)
    return known
