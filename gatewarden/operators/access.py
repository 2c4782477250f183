"""Who holds what: lookups, held permissions, holders, snapshot merge and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.plans.joins import skew_join
from gatewarden.schemas import Estate


def active_assignments(assignment: DataFrame, subject_id: str | None = None) -> DataFrame:
    """Active assignments, of one subject when asked for."""
    active = assignment.where(F.col("is_active"))
    return active if subject_id is None else active.where(F.col("subject_id") == subject_id)


def lookup(table: DataFrame, entity_id: str) -> DataFrame:
    """The row with this id; the filter reaches the scan of stored tables."""
    return table.where(F.col("id") == entity_id)


def escalation_paths_of(estate: Estate, subjects: DataFrame) -> DataFrame:
    """Escalation paths whose subject is among ``subjects`` (column ``id``)."""
    wanted = subjects.select(F.col("id").alias("subject_id"))
    return estate.escalation_path.join(wanted, "subject_id", "left_semi")


def held(estate: Estate, *permission_columns: str) -> DataFrame:
    """Distinct (subject_id, permission_id) over active assignments, with permission columns.

    Ids without a permission row drop out. Duplicates are removed before the
    join, so a permission that everyone holds is shuffled once per holder.
    """
    wanted = estate.permission.select(F.col("id").alias("permission_id"), *permission_columns)
    return skew_join(active_pairs(estate), wanted, "permission_id")


def active_pairs(estate: Estate) -> DataFrame:
    """Distinct (subject_id, permission_id) over active assignments, dangling ids included."""
    kept = estate.derived("held_pair")
    if kept is not None:
        return kept
    return active_assignments(estate.assignment).select("subject_id", "permission_id").distinct()


def active_with_permission(estate: Estate, *permission_columns: str) -> DataFrame:
    """Active assignments (not deduplicated) with columns of their permission."""
    wanted = estate.permission.select(
        F.col("id").alias("permission_id"),
        *[F.col(c).alias(f"permission_{c}") for c in permission_columns],
    )
    return skew_join(active_assignments(estate.assignment), wanted, "permission_id")


def subject_actions(estate: Estate) -> DataFrame:
    """Distinct (subject_id, action) over the permissions each subject holds."""
    kept = estate.derived("subject_action")
    if kept is not None:
        return kept
    return (
        held(estate, "actions")
        .select("subject_id", F.explode("actions").alias("action"))
        .distinct()
    )


def holders(estate: Estate, *subject_columns: str) -> DataFrame:
    """Distinct (permission_id, subject_id) with existing subjects and their columns."""
    pairs = active_pairs(estate).select("permission_id", "subject_id")
    wanted = estate.subject.select(F.col("id").alias("subject_id"), *subject_columns)
    return skew_join(pairs, wanted, "subject_id")


def latest(table: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes last in ``order``.

    ``max_by`` combines map-side, so a key with very many versions never gathers
    on one task the way a window over the key would.
    """
    keys = [key] if isinstance(key, str) else list(key)
    row = F.struct(*table.columns)
    return (
        table.groupBy(*keys)
        .agg(F.max_by(row, F.struct(*order)).alias("__row"))
        .select("__row.*")
    )


def first_by(table: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the one that comes first in ``order`` (map-side combine)."""
    row = F.struct(*table.columns)
    return (
        table.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")
    )


def merge_snapshots(snapshots: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Union of snapshots of one table; of rows with equal id the last snapshot wins.

    Within one snapshot the row with the highest ``ingest_seq`` (if any) wins.
    """
    merged = None
    for position, snapshot in enumerate(snapshots):
        tagged = snapshot.withColumn("__snapshot", F.lit(position))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    order = ["__snapshot"] + (["ingest_seq"] if "ingest_seq" in merged.columns else [])
    return latest(merged, key, order).drop("__snapshot")


def source_counts(estate: Estate) -> DataFrame:
    """Rows of the five entity tables per source: (source, entity, n)."""
    counts = None
    for entity in ("subject", "permission", "resource", "assignment", "escalation_path"):
        one = (
            getattr(estate, entity)
            .groupBy("source")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("source", F.lit(entity).alias("entity"), "n")
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def estate_totals(estate: Estate) -> DataFrame:
    """One row with the row counts of the main tables."""
    counts = source_counts(estate)
    return counts.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("entity") == entity, F.col("n"))), F.lit(0))
            .cast("bigint")
            .alias(f"{entity}s")
            for entity in ("subject", "permission", "resource", "assignment", "escalation_path")
        ]
    )


def action_counts(estate: Estate) -> DataFrame:
    """Number of distinct actions per subject."""
    return subject_actions(estate).groupBy("subject_id").agg(F.count(F.lit(1)).alias("unique_actions"))


def permission_counts(estate: Estate) -> DataFrame:
    """Held permissions, privileged ones and action concentration, per subject."""
    sizes = held(estate, "is_privileged", F.size("actions").alias("__n"))
    total = F.sum("__n").cast("double")
    return sizes.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("total_permissions"),
        F.count_if(F.col("is_privileged")).alias("privileged_permissions"),
        F.coalesce(
            F.sum((F.col("__n") * F.col("__n")).cast("double")) / F.nullif(total * total, F.lit(0.0)),
            F.lit(0.0),
        ).alias("permission_concentration"),
    )
