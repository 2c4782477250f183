"""Peer groups: medians, deviations and similarity to the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewarden.operators.access import permission_counts, subject_actions
from gatewarden.plans.durable import materialize
from gatewarden.plans.joins import skew_join
from gatewarden.schemas import Estate

PEER_KEY = ["peer_department", "peer_type"]


def peer_department(department: Column) -> Column:
    """Missing and empty departments count as 'unknown'."""
    filled = F.coalesce(F.nullif(department, F.lit("")), F.lit("unknown"))
    return F.trim(F.lower(filled))


def peer_members(subject: DataFrame) -> DataFrame:
    """(subject_id, peer key) of every subject that is not a group."""
    return subject.where(F.col("type") != "group").select(
        F.col("id").alias("subject_id"),
        peer_department(F.col("department")).alias("peer_department"),
        F.col("type").alias("peer_type"),
    )


def peer_permission_counts(estate: Estate, counts: DataFrame | None = None) -> DataFrame:
    """Peer members with their number of held permissions (0 when none)."""
    counts = permission_counts(estate) if counts is None else counts
    return peer_members(estate.subject).join(
        counts.select("subject_id", "total_permissions"), "subject_id", "left"
    ).withColumn("total_permissions", F.coalesce("total_permissions", F.lit(0).cast("bigint")))


def peer_statistics(members: DataFrame) -> DataFrame:
    """Size, upper median, mean and population deviation of each peer group.

    The upper median sorted[n div 2] is read off the group's histogram of
    permission counts. The histogram is combined map-side and has one row per
    distinct count, so a group with most of the subjects stays small here.
    """
    histogram = members.groupBy(*PEER_KEY, "total_permissions").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy(*PEER_KEY).orderBy("total_permissions")
    whole = Window.partitionBy(*PEER_KEY)
    ranked = histogram.withColumn("upto", F.sum("n").over(by_count)).withColumn(
        "group_size", F.sum("n").over(whole)
    )
    past_middle = F.col("upto") > F.floor(F.col("group_size") / 2)
    x, n = F.col("total_permissions").cast("double"), F.col("n").cast("double")
    moments = ranked.groupBy(*PEER_KEY).agg(
        F.max("group_size").alias("group_size"),
        F.min(F.when(past_middle, F.col("total_permissions"))).cast("double").alias("upper_median"),
        (F.sum(x * n) / F.sum(n)).alias("peer_mean"),
        (F.sum(x * x * n) / F.sum(n)).alias("__mean_square"),
        F.min("total_permissions").alias("__low"),
        F.max("total_permissions").alias("__high"),
    )
    spread = F.sqrt(F.greatest(F.col("__mean_square") - F.col("peer_mean") * F.col("peer_mean"), F.lit(0.0)))
    return moments.select(
        *PEER_KEY,
        "group_size",
        F.when(F.col("group_size") < 2, F.lit(1.0)).otherwise(F.col("upper_median")).alias("upper_median"),
        "peer_mean",
        F.when(F.col("__low") == F.col("__high"), F.lit(0.0)).otherwise(spread).alias("peer_std"),
    )


def peer_scores(estate: Estate, counts: DataFrame | None = None) -> DataFrame:
    """Ratio to the peer median and z-score, for every subject that is not a group."""
    members = peer_permission_counts(estate, counts)
    scored = skew_join(members, peer_statistics(members), PEER_KEY)
    total, median = F.col("total_permissions").cast("double"), F.col("upper_median")
    return scored.select(
        "subject_id",
        *PEER_KEY,
        "group_size",
        "total_permissions",
        F.when(median > 0, total / median).otherwise(F.lit(1.0)).alias("permission_to_peer_median_ratio"),
        F.when((F.col("group_size") < 3) | (F.col("peer_std") == 0), F.lit(0.0))
        .otherwise((total - F.col("peer_mean")) / F.col("peer_std"))
        .alias("peer_group_deviation_score"),
    )


def peer_similarity(estate: Estate) -> DataFrame:
    """Cosine of each subject's action set with the mean of its peers' action sets.

    With c(a) the number of peer-group members holding action a, and S the
    subject's actions, the dot product is the sum of c-1 over S, and the squared
    length of the peers' sum is (sum of c^2) minus the sum of 2c-1 over S. So the
    similarity needs per-group action counts only, never pairs of subjects.
    Subjects without actions score 0 and appear here only if they are peers.
    """
    members = peer_members(estate.subject)
    actions = subject_actions(estate).join(members, "subject_id")
    # Stored, so that its size is known and every subject's actions need not be dealt by group and action.
    counts = materialize(actions.groupBy(*PEER_KEY, "action").agg(F.count(F.lit(1)).alias("c")), "peer-actions")
    squares = counts.groupBy(*PEER_KEY).agg(
        F.sum((F.col("c") * F.col("c")).cast("double")).alias("sum_squares")
    )
    sizes = members.groupBy(*PEER_KEY).agg(F.count(F.lit(1)).alias("group_size"))
    group_facts = sizes.join(squares, PEER_KEY, "left")
    own = skew_join(actions, counts, [*PEER_KEY, "action"]).groupBy("subject_id").agg(
        F.count(F.lit(1)).cast("double").alias("own_actions"),
        F.sum(F.col("c") - 1).cast("double").alias("dot"),
        F.sum(2 * F.col("c") - 1).cast("double").alias("own_share"),
    )
    joined = skew_join(members, group_facts, PEER_KEY).join(own, "subject_id", "left")
    rest = F.col("sum_squares") - F.col("own_share")
    return joined.select(
        "subject_id",
        F.when(F.coalesce("own_actions", F.lit(0.0)) == 0, F.lit(0.0))
        .when(F.col("group_size") == 1, F.lit(1.0))
        .when(rest <= 0, F.lit(0.0))
        .otherwise(F.col("dot") / (F.sqrt("own_actions") * F.sqrt(rest)))
        .alias("peer_group_cosine_similarity"),
    )
