"""Python workers must be able to import this package, and get batches that fit beside one another."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

import gatewarden

HOME = os.path.dirname(os.path.dirname(os.path.abspath(gatewarden.__file__)))


#: Bytes of rows that Spark hands to a worker at once (a longer row is a batch of its own). Every task holds a
#: batch or two in the JVM and in Python, so Spark's default of 64 MB would be most of a small executor.
BATCH_BYTES = 8 << 20


def importable(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path; on a cluster without that folder, submit with --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if HOME not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, known]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
