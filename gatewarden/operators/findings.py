"""Posture findings measured over event and assignment tables.

The tenant documents report these as given; here the same quantities are taken
from the tables themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewarden.functions.scalars import as_of_lit, ratio_or_zero, whole_days
from gatewarden.operators.access import active_assignments, held
from gatewarden.operators.behaviour import recent
from gatewarden.plans.joins import skew_join
from gatewarden.schemas import Estate


def peer_volumes(events: DataFrame, members: DataFrame, as_of: str, counted: Column, days: int = 30) -> DataFrame:
    """Counted events per member against the upper median of its peer group.

    ``members``: actor_id, peer_group. Members without events count as zero. The
    median is read off the group's histogram of counts.
    """
    counts = recent(events, as_of, days).where(counted).groupBy("actor_id").agg(F.count(F.lit(1)).alias("n"))
    volumes = members.join(counts, "actor_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    histogram = volumes.groupBy("peer_group", "n").agg(F.count(F.lit(1)).alias("m"))
    by_count = Window.partitionBy("peer_group").orderBy("n")
    ranked = histogram.withColumn("upto", F.sum("m").over(by_count)).withColumn(
        "size", F.sum("m").over(Window.partitionBy("peer_group"))
    )
    medians = ranked.groupBy("peer_group").agg(
        F.min(F.when(F.col("upto") > F.floor(F.col("size") / 2), F.col("n"))).alias("peer_median"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("m")).alias("peer_mean"),
    )
    return skew_join(volumes, medians, "peer_group").select(
        "actor_id", "peer_group", "n", "peer_median", "peer_mean",
        ratio_or_zero(F.col("n"), F.col("peer_median")).alias("ratio_to_peer"),
    )


def ended_with_access(estate: Estate, ends: DataFrame, as_of: str) -> DataFrame:
    """Subjects whose contract or employment ended but who hold active assignments.

    ``ends``: subject_id, ended_at.
    """
    over = ends.withColumn("days_since_end", whole_days(as_of_lit(as_of), F.col("ended_at"))).where(
        F.col("days_since_end") > 0
    )
    active = active_assignments(estate.assignment).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("active_permissions")
    )
    return over.join(active, "subject_id").select("subject_id", "days_since_end", "active_permissions")


def outside_scope(events: DataFrame, scopes: DataFrame) -> DataFrame:
    """Per actor, the places (``target_type``) it touched that its scope does not list.

    ``scopes``: actor_id, place.
    """
    touched = events.where(F.col("target_type") != "").select(
        "actor_id", F.col("target_type").alias("place")
    ).distinct()
    return touched.join(scopes, ["actor_id", "place"], "left_anti")


def barrier_crossings(access_desks: DataFrame, barriers: DataFrame) -> DataFrame:
    """Subjects on one side of an information barrier with access to the other side.

    ``access_desks``: subject_id, home_desk, desk. ``barriers``: id, side_a, side_b.
    """
    sides = barriers.select("id", F.explode("side_a").alias("home_desk"), F.col("side_b").alias("far")).unionByName(
        barriers.select("id", F.explode("side_b").alias("home_desk"), F.col("side_a").alias("far"))
    )
    across = sides.select(F.col("id").alias("barrier_id"), "home_desk", F.explode("far").alias("desk"))
    return skew_join(access_desks.distinct(), across, ["home_desk", "desk"]).select(
        "subject_id", "barrier_id", "home_desk", "desk"
    )


def holds_all(estate: Estate, actions: Sequence[str]) -> DataFrame:
    """Subjects whose permissions together hold every one of the actions."""
    bit = F.lit(None).cast("bigint")
    for position, action in enumerate(actions):
        bit = F.when(F.col("action") == action, F.lit(1 << position)).otherwise(bit)
    return (
        held(estate, "actions")
        .select("subject_id", F.explode("actions").alias("action"))
        .where(F.col("action").isin(*actions))
        .groupBy("subject_id")
        .agg(F.bit_or(bit.cast("bigint")).alias("mask"))
        .where(F.col("mask") == (1 << len(set(actions))) - 1)
        .select("subject_id")
    )
