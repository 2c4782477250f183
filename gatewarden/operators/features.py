"""The four feature tables and the flat model vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.functions.fixed_values import GRANTING_SYSTEMS, HIGH_RISK_ACTIONS, STATUS_CODES, TYPE_CODES
from gatewarden.functions.scalars import as_of_lit, fixed_map, whole_days
from gatewarden.operators import access, behaviour, drift, escalation, graph, identity, peers, sod
from gatewarden.plans.durable import materialize
from gatewarden.plans.joins import skew_join
from gatewarden.schemas import Estate

SUBJECT_VECTOR = (
    "type_code", "status_code", "account_age_days", "source_system_count", "department_code",
    "manager_depth", "total_permissions", "privileged_permissions", "unique_actions",
    "unique_resources_reachable", "permission_to_peer_median_ratio", "permission_concentration",
    "days_since_last_activity", "avg_daily_api_calls_30d", "usage_ratio", "login_time_entropy",
    "distinct_source_ips_30d", "mfa_usage_rate", "degree_centrality", "betweenness_centrality",
    "distance_to_nearest_critical_resource", "escalation_paths_through_identity",
    "peer_group_cosine_similarity", "permissions_added_7d", "permissions_added_30d",
    "permissions_added_90d", "permissions_removed_7d", "permissions_removed_30d",
    "permissions_removed_90d", "net_drift_rate", "days_since_last_access_review",
    "cross_system_consistency_score", "sod_pair_membership_count", "peer_group_deviation_score",
)


@dataclass(frozen=True)
class FeatureSettings:
    """Moments the features refer to, and the optional parts."""

    as_of: str
    event_as_of: str | None = None
    drift_as_of: str | None = None
    #: Largest deviation of betweenness to accept for a sample of sources; None is exact.
    betweenness_error: float | None = None
    with_betweenness: bool = True
    review_events: Column | None = None


def profile(estate: Estate, as_of: str) -> DataFrame:
    """Columns read straight off the subject row."""
    now = as_of_lit(as_of)
    return estate.subject.select(
        F.col("id").alias("subject_id"),
        "source",
        "type",
        "status",
        F.coalesce(F.nullif("department", F.lit("")), F.lit("unknown")).alias("department"),
        F.coalesce(whole_days(now, F.col("created_at")), F.lit(0).cast("bigint")).alias("account_age_days"),
        F.coalesce(whole_days(now, F.col("last_seen")), F.lit(-1).cast("bigint")).alias(
            "days_since_last_activity"
        ),
        behaviour.mfa_usage_rate(F.col("mfa_enabled")).alias("mfa_usage_rate"),
        "trust_policy_open",
    )


def permission_profile(estate: Estate) -> DataFrame:
    """Counts, concentration and distinct actions of what each subject holds."""
    return access.permission_counts(estate).join(access.action_counts(estate), "subject_id", "left")


def source_system_counts(members: DataFrame) -> DataFrame:
    return members.select("subject_id", F.col("source_count").alias("source_system_count"))


def relationship_features(
    estate: Estate, members: DataFrame, pairs: DataFrame, scores: DataFrame | None = None
) -> DataFrame:
    """Consistency across systems, violated SoD pairs, deviation from peers (``scores`` if known)."""
    consistency = skew_join(
        members.select("subject_id", "component_id"), identity.consistency_scores(members), "component_id"
    ).select("subject_id", "cross_system_consistency_score")
    scores = peers.peer_scores(estate) if scores is None else scores
    deviation = scores.select("subject_id", "peer_group_deviation_score")
    return (
        estate.subject.select(F.col("id").alias("subject_id"))
        .join(consistency, "subject_id", "left")
        .join(sod.sod_counts(estate, members, pairs), "subject_id", "left")
        .join(deviation, "subject_id", "left")
        .select(
            "subject_id",
            F.coalesce("cross_system_consistency_score", F.lit(1.0)).alias("cross_system_consistency_score"),
            F.coalesce("sod_pair_membership_count", F.lit(0).cast("bigint")).alias("sod_pair_membership_count"),
            F.coalesce("peer_group_deviation_score", F.lit(0.0)).alias("peer_group_deviation_score"),
        )
    )


def subject_features(
    estate: Estate, settings: FeatureSettings, members: DataFrame, pairs: DataFrame
) -> DataFrame:
    """Every subject (groups too) with all subject and relationship columns.

    Each part is already one row per subject and hashed by subject_id, so the
    joins line up without moving the parts again.
    """
    event_moment = settings.event_as_of or settings.as_of
    drift_moment = settings.drift_as_of or settings.as_of
    # Reach and graph read these.
    for name, table in (("held_edge", graph.held_edges), ("permission_resource", graph.permission_resources)):
        if estate.derived(name) is None:
            estate = estate.with_derived(**{name: materialize(table(estate), name)})
    # Read by several parts, so stored: one row per subject each.
    counts = materialize(permission_profile(estate), "permission-profile")
    scores = materialize(peers.peer_scores(estate, counts), "peer-scores")
    parts = [
        counts,
        source_system_counts(members),
        graph.manager_depth(estate.subject),
        graph.blast_radius(estate).select(
            "subject_id",
            F.col("direct_resources").alias("unique_resources_reachable"),
            F.col("escalation_resources").alias("escalation_paths_through_identity"),
        ),
        scores.select("subject_id", F.col("permission_to_peer_median_ratio").alias("__ratio")),
        peers.peer_similarity(estate),
        _similarity_of_groups(estate),
        behaviour.activity(estate, event_moment),
        behaviour.usage_ratios(estate),
        drift.permission_drift(estate, drift_moment),
        relationship_features(estate, members, pairs, scores),
    ]
    numbered = graph.numbered(estate)
    parts.append(graph.degree_centrality(estate, numbered))
    parts.append(graph.distance_to_critical(estate, numbered))
    if settings.with_betweenness:
        parts.append(graph.betweenness_centrality(estate, numbered, error=settings.betweenness_error))
    if settings.review_events is not None:
        parts.append(drift.days_since_review(estate, event_moment, settings.review_events))
    joined = profile(estate, settings.as_of)
    for part in parts:
        joined = joined.join(part, "subject_id", "left")
    for name in ("betweenness_centrality", "days_since_last_access_review"):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None))

    def whole(name: str, default: int = 0) -> Column:
        return F.coalesce(F.col(name), F.lit(default)).cast("bigint").alias(name)

    def real(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)).alias(name)

    # Group subjects have no peers: their median counts as 1.
    own_total = F.coalesce("total_permissions", F.lit(0)).cast("double")
    return joined.select(
        "subject_id", "source", "type", "status", "department", "account_age_days",
        whole("source_system_count", 1),
        whole("manager_depth"),
        whole("total_permissions"), whole("privileged_permissions"), whole("unique_actions"),
        whole("unique_resources_reachable"),
        F.when(F.col("type") == "group", own_total).otherwise(F.col("__ratio")).alias(
            "permission_to_peer_median_ratio"
        ),
        real("permission_concentration"),
        "days_since_last_activity",
        real("avg_daily_api_calls_30d"), real("usage_ratio"), real("login_time_entropy"),
        whole("distinct_source_ips_30d"),
        "mfa_usage_rate",
        real("degree_centrality"), real("betweenness_centrality"),
        whole("distance_to_nearest_critical_resource", -1),
        whole("escalation_paths_through_identity"),
        F.coalesce("peer_group_cosine_similarity", "__group_similarity", F.lit(0.0)).alias(
            "peer_group_cosine_similarity"
        ),
        *[whole(f"permissions_{change}_{w}d") for change in ("added", "removed") for w in drift.WINDOWS],
        real("net_drift_rate"),
        whole("days_since_last_access_review", -1),
        real("cross_system_consistency_score", 1.0),
        whole("sod_pair_membership_count"),
        real("peer_group_deviation_score"),
        "trust_policy_open",
    )


def _similarity_of_groups(estate: Estate) -> DataFrame:
    """Group subjects have no peers: 1 with any action, else 0 (the default)."""
    groups = estate.subject.where(F.col("type") == "group").select(F.col("id").alias("subject_id"))
    with_actions = access.subject_actions(estate).select("subject_id")
    return groups.join(with_actions, "subject_id", "left_semi").withColumn("__group_similarity", F.lit(1.0))


def is_high_risk(action: Column) -> Column:
    return action.isin(*HIGH_RISK_ACTIONS) | F.endswith(action, F.lit(":*")) | (action == "*")


def permission_features(estate: Estate, with_usage: bool = True) -> DataFrame:
    """One row per permission: size, risk, breadth, holders by type, path participation."""
    by_holder = access.holders(estate, "type").groupBy("permission_id").agg(
        F.count(F.lit(1)).alias("holder_count"),
        F.count_if(F.col("type") == "human").alias("__humans"),
        F.count_if(F.col("type") == "service_account").alias("__services"),
        F.count_if(F.col("type") == "ai_agent").alias("__agents"),
    )
    star = F.lit("*")
    base = estate.permission.select(
        F.col("id").alias("permission_id"),
        F.size("actions").cast("bigint").alias("total_actions"),
        F.size(F.filter("actions", is_high_risk)).cast("bigint").alias("high_risk_action_count"),
        (
            F.exists("actions", lambda a: F.contains(a, star))
            | F.exists("resources", lambda r: F.contains(r, star))
        ).alias("wildcard_presence"),
        F.size("resources").cast("bigint").alias("resource_scope_breadth"),
        "is_privileged",
        F.size("risk_keywords").cast("bigint").alias("risk_keyword_count"),
    )
    joined = base.join(by_holder, "permission_id", "left").join(
        escalation.escalation_participation(estate), "permission_id", "left"
    )
    if with_usage:
        joined = joined.join(behaviour.holder_usage(estate), "permission_id", "left")
    else:
        joined = joined.withColumn("average_usage_rate_across_holders", F.lit(0.0))
    zero = F.lit(0).cast("bigint")
    total = F.greatest(F.coalesce("holder_count", zero), F.lit(1)).cast("double")

    def share(name: str, alias: str) -> Column:
        return (F.coalesce(name, zero) / total).alias(alias)

    return joined.select(
        "permission_id", "total_actions", "high_risk_action_count", "wildcard_presence",
        "resource_scope_breadth",
        F.coalesce("holder_count", zero).alias("holder_count"),
        share("__humans", "human_share"),
        share("__services", "service_share"),
        share("__agents", "agent_share"),
        F.coalesce("average_usage_rate_across_holders", F.lit(0.0)).alias("average_usage_rate_across_holders"),
        "is_privileged",
        "risk_keyword_count",
        F.coalesce("escalation_chain_participation_count", zero).alias("escalation_chain_participation_count"),
    )


def granted_by_type(granted_by: Column) -> Column:
    who = F.coalesce(F.nullif(granted_by, F.lit("")), F.lit("unknown"))
    return (
        F.when(who.isin(*GRANTING_SYSTEMS), "system")
        .when(F.contains(F.lower(who), F.lit("auto")), "automation")
        .when(F.contains(who, F.lit("@")), "human")
        .otherwise("unknown")
    )


def assignment_features(estate: Estate, as_of: str, pairs: DataFrame) -> DataFrame:
    """One row per active assignment."""
    now = as_of_lit(as_of)
    conflicted = sod.sod_pair_assignments(estate, pairs).withColumn("__sod", F.lit(True))
    base = access.active_assignments(estate.assignment).select(
        F.col("id").alias("assignment_id"),
        "subject_id",
        "permission_id",
        F.coalesce(whole_days(now, F.col("granted_at")), F.lit(0).cast("bigint")).alias("assignment_age_days"),
        F.coalesce(whole_days(now, F.col("last_used")), F.lit(-1).cast("bigint")).alias("days_since_last_used"),
        granted_by_type(F.col("granted_by")).alias("granted_by_type"),
        F.coalesce(F.col("justification") != "", F.lit(False)).alias("has_business_justification"),
    )
    return base.join(conflicted, "assignment_id", "left").withColumn(
        "is_sod_pair_member", F.coalesce("__sod", F.lit(False))
    ).drop("__sod")


def with_vector_codes(features: DataFrame) -> DataFrame:
    """Numeric codes of the categorical columns (the department is hashed)."""
    types = fixed_map({k: str(v) for k, v in TYPE_CODES.items()})
    statuses = fixed_map({k: str(v) for k, v in STATUS_CODES.items()})
    return (
        features.withColumn("type_code", F.coalesce(types[F.col("type")].cast("double"), F.lit(0.0)))
        .withColumn("status_code", F.coalesce(statuses[F.col("status")].cast("double"), F.lit(0.0)))
        .withColumn(
            "department_code", F.pmod(F.xxhash64("department"), F.lit(10000)).cast("double") / F.lit(10000.0)
        )
    )


def flat_vectors(features: DataFrame) -> DataFrame:
    """(subject_id, features): the 34 values as an ML vector in their fixed order."""
    assembler = VectorAssembler(inputCols=list(SUBJECT_VECTOR), outputCol="features")
    return assembler.transform(with_vector_codes(features)).select("subject_id", "features")
