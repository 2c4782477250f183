"""Python workers must be able to import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

import gatewarden

HOME = os.path.dirname(os.path.dirname(os.path.abspath(gatewarden.__file__)))


def importable(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path; on a cluster without that folder, submit with --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if HOME not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, known]))
