"""Session helpers: one place for the SQL settings every operator assumes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on. All are runtime SQL confs, so they can be applied to a
# session someone else built (the driver, a notebook, a cluster job).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (UTC session clock, AQE with skew-join handling)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


# Cluster sizing (no master given): many shuffle partitions that AQE coalesces towards
# 256 MiB each, 256 MiB file splits, and skewed partitions (a node holding a large share
# of the rows) split by AQE. Partitions then stay well inside executor memory at 100 TB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "fleetlens") -> SparkSession:
    """Session for local runs, tests and the bench (``master="local[N]"``); on a cluster
    pass no master and the cluster sizing in ``CLUSTER_CONF`` applies."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        b = (b.config("spark.ui.enabled", "false")
              .config("spark.ui.showConsoleProgress", "false")
              .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
              .config("spark.driver.memory", os.environ.get("FLEETLENS_DRIVER_MEMORY", "16g")))
    else:
        for k, v in CLUSTER_CONF.items():
            b = b.config(k, v)
        if shuffle_partitions:
            b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_own_folder = ""


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir`` for tables that a job writes and reads again.
    Where that is unset, a local session (one JVM, as in tests) gets one of its own and any other
    an error."""
    global _own_folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder = _own_folder or tempfile.mkdtemp(prefix="fleetlens-shared-")
    return f"{root.rstrip('/')}/fleetlens-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it in ``spark.checkpoint.dir``. A
    machine-local fallback would lose a stream's progress with its driver, so an unset
    folder is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise ValueError("set spark.checkpoint.dir to a shared folder, or pass a checkpoint folder")
    spark.sparkContext.setCheckpointDir(d)
    return d
