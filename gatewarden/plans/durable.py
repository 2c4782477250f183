"""Intermediate tables that survive the loss of executors.

Iterative operators write each round as Parquet below the shared folder named
by ``spark.checkpoint.dir``. Reading the files back cuts the lineage, gives the
optimizer exact sizes (so it can decide on broadcasts), and lets a lost
executor's work be redone from storage instead of from the start.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def durable_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="gatewarden-")
    context.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table."""
    stored, _ = materialize_with(df, label, {})
    return stored


def materialize_with(
    df: DataFrame, label: str, measures: dict[str, Column]
) -> tuple[DataFrame, dict[str, object]]:
    """Like :func:`materialize`, also returning aggregates taken during the write.

    The measures ride along with the write, so a loop needs no second job to
    learn whether it has converged.
    """
    spark = df.sparkSession
    path = f"{durable_root(spark)}/gatewarden/{label}-{uuid.uuid4().hex}"
    values: dict[str, object] = {}
    if measures:
        observation = Observation()
        watched = df.observe(observation, *[c.alias(n) for n, c in measures.items()])
        watched.write.parquet(path)
        values = observation.get
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), values


def release(df: DataFrame) -> None:
    """Delete a stored intermediate table that no later plan reads."""
    spark = df.sparkSession
    root = f"{durable_root(spark)}/gatewarden/"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = hadoop.Path(folder)
        if path.toUri().getPath().startswith(hadoop.Path(root).toUri().getPath()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
