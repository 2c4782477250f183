"""Exact ranks, in sorted or pseudo-random order, without sorting a whole group on one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gatewarden.plans.durable import materialize

BUCKETS = 4096


def hashed_rank(df: DataFrame, id_column: str, seed: int, groups: list[str] | None = None) -> DataFrame:
    """Add ``place`` (1..n) and ``group_size``: rank by a seeded hash of the id, per group.

    Rows fall into equal hash ranges; ranges are ranked on their own and shifted by
    the number of rows in earlier ranges. A group with almost all rows is thus
    spread over many tasks, and the order depends only on ids and seed. The
    range counts are at most BUCKETS rows per group.
    """
    keys = groups or []
    salted = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_column))).withColumn(
        "__b", F.floor(F.col("__h") / F.lit(2.0**64 / BUCKETS)).cast("int")
    )
    counts = salted.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    per_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = per_group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(per_group).alias("group_size"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__h", id_column)
    return (
        salted.withColumn("__r", F.row_number().over(inside))
        .join(offsets, [*keys, "__b"])
        .withColumn("place", F.col("__r") + F.col("__offset"))
        .drop("__h", "__b", "__r", "__offset")
    )


def ordered_rank(df: DataFrame, column: str) -> DataFrame:
    """Add ``place`` (0..n-1) in the order of ``column``, whose values are distinct.

    Rows are dealt by ranges of the column and stored with the number of their range; ranges are
    ranked on their own and shifted by the rows of earlier ones (one row per range).
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = materialize(
        df.repartitionByRange(ranges, column).withColumn("__part", F.spark_partition_id()), "ranges"
    )
    counts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(column)
    return (
        spread.withColumn("__r", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "__part")
        .withColumn("place", (F.col("__r") + F.col("__offset")).cast("long"))
        .drop("__part", "__r", "__offset")
    )
