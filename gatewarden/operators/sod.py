"""Segregation of duties: conflicting keys held by one identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.functions.fixed_values import ERP_SOD_PAIRS
from gatewarden.functions.scalars import erp_key, is_erp_action
from gatewarden.operators.access import active_pairs, active_with_permission
from gatewarden.operators.identity import identity_units
from gatewarden.plans.joins import skew_join
from gatewarden.plans.tables import literal_table
from gatewarden.schemas import Estate


def pair_table(spark, pairs: Sequence[tuple[str, str]] = ERP_SOD_PAIRS) -> DataFrame:
    """Conflict matrix as a table (pair_no, key_a, key_b)."""
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    return literal_table(spark, "pair_no int, key_a string, key_b string", rows)


def pair_sides(pairs: DataFrame) -> DataFrame:
    """One row per side: bit 1 for key_a, bit 2 for key_b."""
    return pairs.select("pair_no", F.col("key_a").alias("key"), F.lit(1).alias("side")).unionByName(
        pairs.select("pair_no", F.col("key_b").alias("key"), F.lit(2).alias("side"))
    )


def conflict_keys(actions: Column, permission_keys: Column) -> Column:
    """Keys a permission stands for: ERP keys, other raw actions, and its declared keys."""
    from_actions = F.transform(actions, lambda a: F.when(is_erp_action(a), erp_key(a)).otherwise(a))
    declared = F.coalesce(permission_keys, F.array().cast("array<string>"))
    return F.array_distinct(F.concat(from_actions, declared))


def sod_violations(estate: Estate, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit_id, pair_no, key_a, key_b) for every identity holding both sides of a pair.

    Sides become bits that are or-ed map-side, first of each permission, then of each
    subject; only permissions whose keys occur in the matrix meet the held pairs.
    """
    keys = estate.permission.select(
        F.col("id").alias("permission_id"),
        F.explode(conflict_keys(F.col("actions"), F.col("permission_keys"))).alias("key"),
    )
    own_sides = skew_join(keys, pair_sides(pairs), "key").groupBy("permission_id", "pair_no").agg(
        F.bit_or("side").alias("sides")
    )
    sides = (
        skew_join(active_pairs(estate), own_sides, "permission_id")
        .groupBy("subject_id", "pair_no")
        .agg(F.bit_or("sides").alias("sides"))
    )
    units = identity_units(estate.subject, members)
    hits = (
        sides.join(units, "subject_id")
        .groupBy("unit_id", "pair_no")
        .agg(F.bit_or("sides").alias("sides"))
        .where(F.col("sides") == 3)
        .select("unit_id", "pair_no")
    )
    return skew_join(hits, pairs, "pair_no")


def sod_violation_members(estate: Estate, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each violation once per subject of the identity, with sources and the cross-system flag."""
    violations = sod_violations(estate, members, pairs)
    units = identity_units(estate.subject, members)
    facts = estate.subject.select(F.col("id").alias("subject_id"), "display_name", "source")
    spans = members.select("subject_id", F.col("sources").alias("unit_sources"))
    bearers = (
        units.join(facts, "subject_id")
        .join(spans, "subject_id", "left")
        .withColumn("sources", F.coalesce("unit_sources", F.array("source")))
        .select("unit_id", "subject_id", "display_name", "sources")
    )
    return skew_join(bearers, violations, "unit_id").withColumn(
        "is_cross_boundary", F.size("sources") > 1
    )


def sod_counts(estate: Estate, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of violated pairs per subject (through its identity)."""
    per_unit = sod_violations(estate, members, pairs).groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("sod_pair_membership_count")
    )
    units = identity_units(estate.subject, members)
    return skew_join(units, per_unit, "unit_id").select("subject_id", "sod_pair_membership_count")


def sod_pair_assignments(estate: Estate, pairs: DataFrame) -> DataFrame:
    """Active assignments whose ERP keys hold one side of a pair the subject completes.

    Only keys from ``netsuite:`` actions count here. Columns: assignment_id.
    """
    erp_sides = skew_join(
        estate.permission.select(F.col("id").alias("permission_id"), F.explode("actions").alias("action"))
        .where(is_erp_action(F.col("action")))
        .select("permission_id", erp_key(F.col("action")).alias("key")),
        pair_sides(pairs),
        "key",
    ).groupBy("permission_id", "pair_no").agg(F.bit_or("side").alias("own_sides"))
    with_sides = skew_join(
        active_with_permission(estate).select(
            F.col("id").alias("assignment_id"), "subject_id", "permission_id"
        ),
        erp_sides,
        "permission_id",
    )
    per_subject = with_sides.groupBy("subject_id", "pair_no").agg(F.bit_or("own_sides").alias("all_sides"))
    own, every = F.col("own_sides"), F.col("all_sides")
    other_side_held = (own.bitwiseAND(F.lit(1)) > 0) & (every.bitwiseAND(F.lit(2)) > 0) | (
        own.bitwiseAND(F.lit(2)) > 0
    ) & (every.bitwiseAND(F.lit(1)) > 0)
    return (
        skew_join(with_sides, per_subject, ["subject_id", "pair_no"])
        .where(other_side_held)
        .select("assignment_id")
        .distinct()
    )
