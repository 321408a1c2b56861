"""Session helpers.

On a cluster the session comes from the platform; ``get_spark`` only fills in
SQL settings that the cluster's configuration leaves unset, so cluster-level
configuration always wins.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# SQL settings this library relies on, applied only where the cluster's own
# configuration (spark-defaults, --conf) gives no value. AQE coalesces the many
# small shuffle partitions of the per-batch aggregates and splits skewed ones.
_SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a bundle group may hold 50 files of 50 MB: 64-bit Arrow offsets for strings and binaries
    "spark.sql.execution.arrow.useLargeVarTypes": "true",
    # streaming state (dedupe keys, per-batch progress) kept in RocksDB, not on the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# Settings fixed when a local session is started (tests, bench): no web UI.
_LOCAL_STARTUP = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set each library default that the session leaves unset (neither in its
    startup configuration nor set at runtime: ``get(key, None)`` is then None)."""
    for key, value in _SQL_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def get_spark(master: str | None = None, app_name: str = "docprep", **conf: str) -> SparkSession:
    """Return the active session (defaults filled in where unset), or build a
    local one (tests, bench); ``conf`` is applied as given."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return apply_defaults(active)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        for key, value in _LOCAL_STARTUP.items():
            builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_defaults(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the setting is absent and the master is local (tests) a fresh scratch
    folder is created and registered, so ``DataFrame.checkpoint()`` can cut lineage.
    On a cluster a machine-local folder would lose data, so the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    path = tempfile.mkdtemp(prefix="docprep-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Repartition (round-robin, by row count) only when the scan has fewer
    partitions than the cluster can run at once.

    A single-row-group file becomes one task; large inputs already have far
    more splits than cores, so on a cluster this is a no-op and adds no shuffle.
    Round-robin keeps document-length skew spread evenly.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
