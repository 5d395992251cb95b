"""Session helpers: builder for tests/bench and per-query session settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", app: str = "sevlake", shuffle_partitions: int = 8,
                  checkpoint: str | None = None) -> SparkSession:
    """Local session for tests and the bench; ``checkpoint`` names its folder
    where the configuration has none.  On a cluster, the cluster's own session
    is used instead and only :func:`prepare` is applied to it."""
    builder = SparkSession.builder
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SEVLAKE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on: UTC session time zone (timestamps in
    the indicator tables are UTC), AQE for runtime join/skew re-planning, and
    Arrow batches that are bounded by bytes too, as texts may be long."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in
    ``spark.checkpoint.dir`` (or set on the context).  Without one there is no
    folder that every executor sees, so this raises; local sessions get one
    from :func:`build_session`."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        raise RuntimeError("No shared folder: set spark.checkpoint.dir to one that the driver and all executors can reach.")
    spark.sparkContext.setCheckpointDir(current)
    return current
