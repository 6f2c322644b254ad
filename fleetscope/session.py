"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "fleetscope", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the plans assume.

    On a cluster pass ``master=None`` and let spark-submit decide; the local
    default is only for tests and the bench.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session (tests) without the setting gets a private folder; on
    a cluster that is an error, because executors would not share it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="fleetscope-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df, keep_partitioning: bool = False):
    """Cut the lineage of a job's result table with a reliable checkpoint.

    Used at job boundaries (per-vehicle styles, per-session features, model
    inputs) so downstream plans start from stored rows instead of re-embedding
    the whole upstream plan in every branch. ``keep_partitioning`` runs the
    checkpoint job without adaptive re-planning so the stored rows keep the
    hash partitioning and sort order of ``df`` (an adaptive final stage does
    not report them).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def stored(df, name: str):
    """``df`` as a new Parquet table in the shared folder: a cut like ``materialize`` that is compact for tables as long as the input."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
