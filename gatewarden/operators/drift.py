"""Change of held permissions over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.functions.scalars import as_of_lit, whole_days
from gatewarden.operators.behaviour import _with_family, actor_subjects
from gatewarden.schemas import Estate

WINDOWS = (7, 30, 90)


def held_at(moment: Column) -> Column:
    """Row predicate: the assignment was in force at ``moment``."""
    return (F.col("granted_at") <= moment) & (
        F.col("is_active") | F.coalesce(F.col("last_used") > moment, F.lit(False))
    )


def permission_drift(estate: Estate, as_of: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Permissions added and removed per window, and the 90-day drift rate, per subject.

    All snapshots are read off one aggregate per (subject, permission): a flag per
    moment, or-ed map-side, instead of one pair of anti joins per window.
    """
    now = as_of_lit(as_of)
    flags = [F.bool_or(held_at(now)).alias("now")] + [
        F.bool_or(held_at(now - F.make_dt_interval(F.lit(w)))).alias(f"then_{w}") for w in windows
    ]
    pairs = estate.assignment.groupBy("subject_id", "permission_id").agg(*flags)
    changes = []
    for w in windows:
        before = F.col(f"then_{w}")
        changes.append(F.count_if(F.col("now") & ~before).alias(f"permissions_added_{w}d"))
        changes.append(F.count_if(~F.col("now") & before).alias(f"permissions_removed_{w}d"))
    widest = max(windows)
    per_subject = pairs.groupBy("subject_id").agg(
        *changes, F.count_if(F.col(f"then_{widest}")).alias("__base")
    )
    return per_subject.withColumn(
        "net_drift_rate",
        (F.col(f"permissions_added_{widest}d") - F.col(f"permissions_removed_{widest}d"))
        / F.greatest(F.col("__base"), F.lit(1)).cast("double"),
    ).drop("__base")


def permission_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(subject_id, permission_id, change) between two tables of held pairs."""
    pair = ["subject_id", "permission_id"]
    flagged = (
        before.select(*pair, F.lit(1).alias("bit"))
        .unionByName(after.select(*pair, F.lit(2).alias("bit")))
        .groupBy(*pair)
        .agg(F.bit_or("bit").alias("bits"))
    )
    return flagged.where(F.col("bits") != 3).select(
        *pair, F.when(F.col("bits") == 2, "added").otherwise("removed").alias("change")
    )


def held_pairs_at(estate: Estate, moment: str) -> DataFrame:
    """Distinct (subject_id, permission_id) in force at a moment."""
    return estate.assignment.where(held_at(as_of_lit(moment))).select(
        "subject_id", "permission_id"
    ).distinct()


def days_since_review(estate: Estate, as_of: str, is_review: Column) -> DataFrame:
    """(subject_id, days_since_last_access_review) from the newest review event."""
    newest = (
        _with_family(estate.event.where(is_review))
        .groupBy("actor_id", "family")
        .agg(F.max("timestamp").alias("newest"))
        .join(actor_subjects(estate.subject), ["actor_id", "family"])
        .groupBy("subject_id")
        .agg(F.max("newest").alias("newest"))
    )
    return newest.select(
        "subject_id",
        whole_days(as_of_lit(as_of), F.col("newest")).alias("days_since_last_access_review"),
    )
