"""Session helpers: a local session for tests/bench, and the shared scratch folder.

On a cluster the session already exists and carries the cluster's settings;
``shared_dir`` then reads ``spark.checkpoint.dir`` from it and never invents a
machine-local folder. Only when the setting is absent (local tests) do we
create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "labwave") -> SparkSession:
    """Session for tests and the local bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # PySpark's per-call stack capture for error context costs about a dozen
        # JVM round trips per Column call; plans here are built from hundreds.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Keep generated classes of many distinct plans compiled (default 100):
        # a session cycling through dozens of queries otherwise recompiles them.
        .config("spark.sql.codegen.cache.maxEntries", "4000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; set a local one only if unset."""
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        current = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="labwave-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
        spark.sparkContext.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique output folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/labwave-out/{name}-{uuid.uuid4().hex}"


def table_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
