"""Feature, label, audit and metric tables: sinks and their readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewarden.functions.scalars import as_of_lit
from gatewarden.operators.access import active_pairs, subject_actions
from gatewarden.plans.durable import materialize
from gatewarden.schemas import TABLES, Estate
from gatewarden.sources.files import split_lists

KEPT_SNAPSHOTS = 100
ENTRIES = "array<struct<violation_class:int,label:int,confidence:double>>"
LABELS = f"map<string,{ENTRIES}>"


def write_feature_matrix(vectors: DataFrame, path: str) -> None:
    """Flat vectors (subject_id, features) as Parquet."""
    vectors.write.mode("overwrite").parquet(path)


def read_feature_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_feature_snapshot(features: DataFrame, path: str, computed_at: str) -> None:
    """Append one snapshot, partitioned by its moment, so lookbacks prune folders."""
    features.withColumn("computed_at", as_of_lit(computed_at)).write.mode("append").partitionBy(
        "computed_at"
    ).parquet(path)


def retained(history: DataFrame, previous: int = KEPT_SNAPSHOTS) -> DataFrame:
    """The current snapshot and the given number before it.

    The moments kept are at most ``previous + 1`` rows, which is the size of the
    broadcast side.
    """
    kept = history.select("computed_at").distinct().orderBy(F.desc("computed_at")).limit(previous + 1)
    return history.join(F.broadcast(kept), "computed_at", "left_semi")


def lookback(history: DataFrame, as_of: str, days: int) -> DataFrame:
    """Snapshots of the last ``days`` days, and always the current one."""
    start = as_of_lit(as_of) - F.make_dt_interval(F.lit(days))
    newest = F.broadcast(history.agg(F.max("computed_at").alias("newest")).withColumn("one", F.lit(1)))
    return (
        history.withColumn("one", F.lit(1))
        .join(newest, "one")
        .where((F.col("computed_at") >= start) | (F.col("computed_at") == F.col("newest")))
        .drop("one", "newest")
    )


def read_labels(spark: SparkSession, path: str, source: str, lines: bool = False) -> DataFrame:
    """(source, pos, subject_id, violation_class, label, confidence) of label files.

    A file is one JSON object {subject: [label, ...]}, read by byte ranges (``files.split_lists``); with
    ``lines`` every line is such an object. Files whose texts do not let themselves be split are read whole.
    """
    if lines:
        return labels_from_json(spark.read.text(path), source)
    entries, broken = split_lists(spark, path)
    hard = [r.file for r in broken.collect()]
    found = _label_rows(
        entries.where(~F.col("file").isin(hard)) if hard else entries, F.col("key"), F.from_json("items", ENTRIES), source
    )
    return found.unionByName(labels_from_json(spark.read.text(hard, wholetext=True), source)) if hard else found


def labels_from_json(text: DataFrame, source: str) -> DataFrame:
    """Rows of label JSON in column ``value``."""
    parsed = text.select(F.explode(F.from_json("value", LABELS)).alias("subject_id", "entries"))
    return _label_rows(parsed, F.col("subject_id"), F.col("entries"), source)


def _label_rows(lists: DataFrame, subject: Column, entries: Column, source: str) -> DataFrame:
    rows = lists.select(subject.alias("subject_id"), F.posexplode(entries).alias("pos", "entry"))
    return rows.select(F.lit(source).alias("source"), "pos", "subject_id", "entry.*")


def append_audit(entries: DataFrame, path: str) -> None:
    """Append audit entries (event, signal_id, at, detail)."""
    entries.write.mode("append").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Training metrics, one row per model."""
    metrics.write.mode("overwrite").parquet(path)


def stored(estate: Estate) -> Estate:
    """The estate with its tables written once, for a run of many operators.

    Normalisation, the distinct held pairs and the distinct actions per subject are
    then not repeated per operator, and every join knows its sizes.
    """
    kept = Estate(**{name: materialize(getattr(estate, name), name) for name in TABLES})
    kept = kept.with_derived(held_pair=materialize(active_pairs(kept), "held-pairs"))
    return kept.with_derived(subject_action=materialize(subject_actions(kept), "subject-actions"))


def read_estate_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored canonical table, columns and types as declared."""
    return spark.read.schema(TABLES[table]).parquet(path)


def write_snapshot(df: DataFrame, path: str, extracted_at: str) -> None:
    """Append one extraction, partitioned by source and moment."""
    df.withColumn("extracted_at", as_of_lit(extracted_at)).write.mode("append").partitionBy(
        "source", "extracted_at"
    ).parquet(path)
