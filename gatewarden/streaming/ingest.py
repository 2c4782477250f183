"""Incremental log ingestion with Structured Streaming.

The normalisers are the batch ones; each feed has its own checkpoint, so a restart
in one never skips events of another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gatewarden.functions.scalars import as_of_lit
from gatewarden.sources import cloudtrail, identity_logs

LATENESS = "1 day"
# Batches of one run whose progress is kept.
KEPT_PROGRESS = 100_000

Normaliser = Callable[[DataFrame], DataFrame]
FEEDS: dict[str, tuple[str, Normaliser]] = {
    "cloudtrail": (cloudtrail.RECORD, cloudtrail.normalise_service),
    "cloudtrail_archive": (cloudtrail.RECORD, cloudtrail.normalise_archive),
    "okta": (identity_logs.OKTA_EVENT, identity_logs.normalise_okta),
    "entra_audit": (identity_logs.ENTRA_AUDIT, identity_logs.normalise_entra_audit),
    "entra_sign_in": (identity_logs.ENTRA_SIGN_IN, identity_logs.normalise_entra_sign_in),
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place))


def stream_feed(
    spark: SparkSession, feed: str, path: str, as_of: str | None = None, files_per_batch: int = 1000,
    checkpoint: str | None = None,
) -> DataFrame:
    """Normalised events of JSON-lines files that land below ``path``.

    A first run starts 24 hours before ``as_of``; no ``as_of`` means from the beginning. A run
    whose ``checkpoint`` exists continues where the last one ended, whatever ``as_of`` says.
    """
    schema, normalise = FEEDS[feed]
    raw = (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    events = normalise(raw)
    if as_of is not None and not (checkpoint and exists(spark, checkpoint)):
        start = as_of_lit(as_of) - F.make_dt_interval(F.lit(1))
        events = events.where(F.col("timestamp") >= start)
    return events


def landed_feed(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """The same events as a batch: everything that has landed below ``path``."""
    schema, normalise = FEEDS[feed]
    return normalise(spark.read.schema(schema).option("recursiveFileLookup", True).json(path))


def without_repeats(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each (source, source_event_id) once; state is dropped behind the watermark."""
    return events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(
        ["source", "source_event_id"]
    )


def daily_summary(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Per day and source: events, by outcome, oldest and newest."""
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("day"), "source")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_if(~F.col("success")).alias("errors"),
            F.min("timestamp").alias("oldest_event"),
            F.max("timestamp").alias("newest_event"),
        )
        .select(F.col("day.start").alias("day"), "source", "total_events", "errors", "oldest_event", "newest_event")
    )


def daily_activity(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Per day and actor: calls, and a sketch of the addresses, which merges over days."""
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("day"), "actor_id")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.hll_sketch_agg(F.nullif("source_ip", F.lit(""))).alias("addresses"),
        )
        .select(F.col("day.start").alias("day"), "actor_id", "calls", "addresses")
    )


def daily_addresses(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Per day: each (actor, address) once, so that a batch rollup can count exactly."""
    return (
        events.where(F.col("source_ip") != "")
        .withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("day"), "actor_id", "source_ip")
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(F.col("day.start").alias("day"), "actor_id", "source_ip", "calls")
    )


def with_open_days(closed: DataFrame, landed: DataFrame, summarise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Emitted days and, from the landed events, the days after them that no watermark has closed yet.

    ``closed`` is what a stream of ``summarise`` has written, ``landed`` the same events as a batch.
    """
    last = closed.groupBy().agg(F.max("day").alias("last")).select(
        F.coalesce(F.col("last") + F.make_dt_interval(F.lit(1)), F.lit("0001-01-01").cast("timestamp")).alias("open_from")
    )
    open_days = summarise(landed.where(F.col("timestamp") >= last.scalar()))
    return closed.unionByName(open_days)


def _last_thirty_days(days: DataFrame, as_of: str) -> DataFrame:
    end = as_of_lit(as_of)
    start = end - F.make_dt_interval(F.lit(30))
    return days.where((F.col("day") >= start) & (F.col("day") < end))


def thirty_day_addresses(days: DataFrame, as_of: str) -> DataFrame:
    """Batch rollup of :func:`daily_addresses` output: distinct addresses over 30 whole days."""
    pairs = _last_thirty_days(days, as_of).select("actor_id", "source_ip").distinct()
    return pairs.groupBy("actor_id").agg(F.count(F.lit(1)).alias("distinct_source_ips_30d"))


def thirty_day_rollup(days: DataFrame, as_of: str) -> DataFrame:
    """Batch rollup of :func:`daily_activity` output: calls per day over 30 whole days, and estimated addresses."""
    return (
        _last_thirty_days(days, as_of)
        .groupBy("actor_id")
        .agg(
            (F.sum("calls") / F.lit(30.0)).alias("avg_daily_api_calls_30d"),
            F.hll_sketch_estimate(F.hll_union_agg("addresses")).alias("estimated_source_ips_30d"),
        )
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has landed, write Parquet, stop; the checkpoint remembers where."""
    # Counts over all batches need the progress of every batch.
    stream.sparkSession.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(KEPT_PROGRESS))
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the watermark, over all batches of the run."""
    if len(query.recentProgress) >= KEPT_PROGRESS:
        raise RuntimeError("the run had more batches than recorded progress; process fewer files per run")
    return sum(
        int(operator.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
