"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "revkit", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs and tests. On a cluster, the existing session's settings win."""
    master = master or os.environ.get("REVKIT_MASTER", "local[8]")
    cores = 8
    if master.startswith("local[") and master[6:-1].isdigit():
        cores = int(master[6:-1])
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # rule evaluation is CPU-heavy per byte of source text: smaller scan
        # splits give more, shorter tasks (and less to redo on a lost executor)
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("REVKIT_MAX_PARTITION_BYTES", "32m"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REVKIT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``);
    create a scratch one only when none is set (local runs and tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured and not current:
        sc.setCheckpointDir(configured)  # DataFrame.checkpoint() reads the context's folder
        return configured
    if configured or current:
        return configured or current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="revkit-ckpt-", dir=os.environ.get("REVKIT_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """A table under the shared folder, computed now: several consumers read it."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), name, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
