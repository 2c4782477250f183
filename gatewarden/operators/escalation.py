"""Privilege-escalation patterns: does a subject's action set contain a pattern?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewarden.functions.fixed_values import ESCALATION_PATTERNS
from gatewarden.operators.access import active_pairs
from gatewarden.plans.joins import skew_join
from gatewarden.plans.tables import literal_table
from gatewarden.schemas import Estate


def pattern_table(spark: SparkSession, patterns: Sequence[tuple] = ESCALATION_PATTERNS) -> DataFrame:
    """(pattern_no, name, actions sorted, confidence, end_result, full_mask)."""
    rows = [
        (i, name, sorted(actions), float(confidence), result, (1 << len(actions)) - 1)
        for i, (name, actions, confidence, result) in enumerate(patterns)
    ]
    schema = (
        "pattern_no int, name string, actions array<string>, confidence double, "
        "end_result string, full_mask bigint"
    )
    return literal_table(spark, schema, rows)


def pattern_coverage(patterns: DataFrame, wildcards: bool = True) -> DataFrame:
    """(action, pattern_no, bit): which held action covers which required action.

    With ``wildcards`` a service wildcard and ``*`` cover the action as well.
    """
    required = patterns.select("pattern_no", F.posexplode("actions").alias("pos", "required"))
    service = F.split_part("required", F.lit(":"), F.lit(1))
    exact = F.array("required")
    wide = F.array(
        F.col("required"),
        F.concat(F.when(F.contains("required", F.lit(":")), service).otherwise(""), F.lit(":*")),
        F.lit("*"),
    )
    return required.select(
        F.explode(F.array_distinct(wide) if wildcards else exact).alias("action"),
        "pattern_no",
        F.expr("shiftleft(1L, pos)").alias("bit"),
    )


def detect_escalation_paths(
    estate: Estate,
    patterns: Sequence[tuple] = ESCALATION_PATTERNS,
    wildcards: bool = True,
    source: str = "aws_iam",
    wording: str = "Has permission to ",
) -> DataFrame:
    """Escalation paths: one row per subject and fully covered pattern.

    Relational division with one combinable aggregate: covered actions set bits, first of each
    permission, then of each subject, and a pattern is contained when all its bits are set. Only
    permissions that cover anything meet the held pairs.
    """
    spark = estate.assignment.sparkSession
    table = pattern_table(spark, patterns)
    actions = estate.permission.select(F.col("id").alias("permission_id"), F.explode("actions").alias("action"))
    masks = (
        skew_join(actions, pattern_coverage(table, wildcards), "action")
        .groupBy("permission_id", "pattern_no")
        .agg(F.bit_or("bit").alias("mask"))
    )
    covered = (
        skew_join(active_pairs(estate), masks, "permission_id")
        .groupBy("subject_id", "pattern_no")
        .agg(F.bit_or("mask").alias("mask"))
    )
    steps = F.transform(
        "actions",
        lambda a: F.struct(
            a.alias("action"), F.lit("*").alias("resource"), F.concat(F.lit(wording), a).alias("description")
        ),
    )
    return (
        skew_join(covered, table, "pattern_no")
        .where(F.col("mask") == F.col("full_mask"))
        .select(
            F.concat("subject_id", F.lit("#"), F.col("pattern_no").cast("string")).alias("id"),
            "subject_id",
            steps.alias("steps"),
            "end_result",
            "confidence",
            F.lit(source).alias("source"),
        )
    )


def escalation_participation(estate: Estate) -> DataFrame:
    """Number of escalation paths in which one of a permission's actions is a step.

    Paths with the same set of step actions are counted together first, so the
    join sees each distinct step set once instead of every path.
    """
    step_sets = (
        estate.escalation_path.select(
            F.array_sort(F.array_distinct(F.col("steps.action"))).alias("step_actions")
        )
        .groupBy("step_actions")
        .agg(F.count(F.lit(1)).alias("paths"))
    )
    by_action = step_sets.select("step_actions", "paths", F.explode("step_actions").alias("action"))
    actions = estate.permission.select(F.col("id").alias("permission_id"), F.explode("actions").alias("action"))
    return (
        skew_join(actions, by_action, "action")
        .groupBy("permission_id", "step_actions")
        .agg(F.first("paths").alias("paths"))
        .groupBy("permission_id")
        .agg(F.sum("paths").alias("escalation_chain_participation_count"))
    )


def has_escalation(estate: Estate) -> DataFrame:
    """Every subject with a flag: is there an escalation path through it?"""
    flagged = estate.escalation_path.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("escalation_paths_through_identity")
    )
    return estate.subject.select(F.col("id").alias("subject_id")).join(flagged, "subject_id", "left").select(
        "subject_id",
        F.coalesce("escalation_paths_through_identity", F.lit(0).cast("bigint")).alias(
            "escalation_paths_through_identity"
        ),
        F.col("escalation_paths_through_identity").isNotNull().alias("has_escalation"),
    )
