"""SparkSession helpers.

On a cluster the session is created by the launcher and we only read its
settings. ``get_spark`` is for tests and local runs: it builds a local
session with the settings the engine relies on (UTC, AQE, no UI) and, only
when ``spark.checkpoint.dir`` is unset, points it at a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int = 8,
              app_name: str = "loanlens", extra_conf: dict[str, str] | None = None) -> SparkSession:
    master = master or os.environ.get("LOANLENS_MASTER", "local[8]")
    b = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        b = b.config(k, v)
    spark = (
        b.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOANLENS_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; a machine-local folder is only chosen for local/test sessions.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="loanlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext; it reads the conf
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
