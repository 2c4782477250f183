"""Session builder with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot permission, manager or mailbox may hold a large share of the rows;
    # the reducer that owns it is split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ... even where keeping the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}
# Only settable when the session is built.
STATIC_SETTINGS = {
    # Column calls need not record their Python call sites.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "gatewarden", master: str | None = None, **extra: str) -> SparkSession:
    """Return a session; on a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATIC_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else started.

    A local session left at Spark's default number of shuffle partitions gets one
    per core; on a cluster that number belongs to the deployment.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    partitions = "spark.sql.shuffle.partitions"
    if spark.sparkContext.master.startswith("local") and spark.conf.get(partitions) == "200":
        spark.conf.set(partitions, str(spark.sparkContext.defaultParallelism))
    return spark
