"""Policy suggestions from templates, patterns in the data, and compliance gaps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewarden.functions import fixed_values as fixed
from gatewarden.plans.durable import materialize
from gatewarden.plans.joins import skew_join
from gatewarden.plans.tables import literal_table

SAMPLE = 5

LOW_USAGE = "Low usage ratio — under 5% utilization"
SPANNING_AGENTS = "AI agents spanning multiple systems"
SOX_MONITORING = "SOX SoD monitoring — financial process conflicts"
CROSS_BOUNDARY = "Cross-boundary IAM-to-ERP access monitoring"

# Fixed values of the data-driven suggestions:
# name, reason, category, action, severity, base confidence, priority, impact, conditions.
DATA_DRIVEN = (
    (LOW_USAGE, "pattern_detected", "zero_trust", "flag_for_review", "medium", 0.70, 0.6,
     "Would flag %s under-utilizing identities",
     (("usage_ratio", "lt", 0.05), ("total_permissions", "gt", 3), ("type", "eq", "human"))),
    (SPANNING_AGENTS, "pattern_detected", "agent_governance", "flag_for_review", "high", 0.80, 0.75,
     "Would monitor %s cross-system agents",
     (("type", "eq", "ai_agent"), ("source_system_count", "gte", 2))),
    (SOX_MONITORING, "compliance_gap", "sox_compliance", "escalate", "critical", 0.90, 0.9,
     "Would flag %s SoD violations",
     (("sod_pair_membership_count", "gt", 0),)),
    (CROSS_BOUNDARY, "compliance_gap", "cross_boundary", "escalate", "critical", 0.85, 0.95,
     "Would monitor %s cross-boundary identities",
     (("source_system_count", "gte", 2), ("privileged_permissions", "gt", 0))),
)


def _rule_json(conditions) -> str:
    return json.dumps(
        [{"feature_name": f, "operator": o, "threshold": t} for f, o, t in conditions], ensure_ascii=False
    )


def native_condition(features: DataFrame, name: str, operator: str, threshold) -> Column:
    """A constant condition as a plain column expression; an absent feature is NULL."""
    if name not in features.columns:
        missing_holds = operator == "neq" or (operator == "not_in" and None not in threshold)
        return F.lit(missing_holds or (operator == "eq" and threshold is None))
    value = F.col(name)
    if operator in ("in", "not_in"):
        inside = F.coalesce(value.isin(*threshold), F.lit(False))
        return inside if operator == "in" else ~inside
    if operator in ("eq", "neq"):
        same = F.equal_null(value, F.lit(threshold))
        return same if operator == "eq" else ~same
    compared = {
        "gt": value > threshold, "lt": value < threshold, "gte": value >= threshold, "lte": value <= threshold,
    }[operator]
    return F.coalesce(compared, F.lit(False))


def native_rule(features: DataFrame, conditions) -> Column:
    holds = F.lit(True)
    for condition in conditions:
        holds = holds & native_condition(features, *condition)
    return holds


def template_hits(features: DataFrame) -> DataFrame:
    """(name, subject_id): subjects a best-practice template would flag, in one pass."""
    names = [
        F.when(native_rule(features, conditions), F.lit(name))
        for name, _, _, _, _, conditions in fixed.POLICY_TEMPLATES
    ]
    return features.select("subject_id", F.explode(F.array_compact(F.array(*names))).alias("name"))


def data_driven_hits(features: DataFrame) -> DataFrame:
    """(name, subject_id) of the fixed patterns; an unknown usage ratio counts as full use."""
    filled = features.withColumn("usage_ratio", F.coalesce("usage_ratio", F.lit(1.0)))
    names = [F.when(native_rule(filled, row[8]), F.lit(row[0])) for row in DATA_DRIVEN]
    return filled.select("subject_id", F.explode(F.array_compact(F.array(*names))).alias("name"))


def department_means(features: DataFrame) -> DataFrame:
    """Departments of three or more subjects with more than 15 permissions on average."""
    return (
        features.where(F.col("department") != "unknown")
        .groupBy("department")
        .agg(F.avg("total_permissions").alias("mean_permissions"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= 3) & (F.col("mean_permissions") > 15))
    )


def department_hits(features: DataFrame, means: DataFrame) -> DataFrame:
    """(name, subject_id, department): subjects above the mean of such a department."""
    rows = skew_join(
        features.select("subject_id", "department", "total_permissions"),
        means.select("department", "mean_permissions"),
        "department",
    ).where(F.col("total_permissions") > F.col("mean_permissions"))
    return rows.select(
        "subject_id",
        F.concat(F.lit("High average permissions in "), "department").alias("name"),
        "department",
    )


def estate_facts(features: DataFrame) -> DataFrame:
    """One row: number of subjects, and whether ERP and cloud identity sources are present."""
    kind = dict(features.dtypes)["source"]
    sources = F.col("source") if kind.startswith("array") else F.array("source")

    def any_of(names) -> Column:
        return F.coalesce(
            F.bool_or(F.arrays_overlap(sources, F.array(*[F.lit(n) for n in names]))), F.lit(False)
        )

    return features.agg(
        F.count(F.lit(1)).alias("total_subjects"),
        any_of(fixed.ERP_SOURCES).alias("has_erp"),
        any_of(fixed.CLOUD_SOURCES).alias("has_cloud"),
    ).withColumn("one", F.lit(1))


def suggestion_subjects(features: DataFrame) -> DataFrame:
    """(name, subject_id) for every candidate suggestion, before any gate."""
    means = materialize(department_means(features), "department-means")
    return (
        template_hits(features)
        .unionByName(data_driven_hits(features))
        .unionByName(department_hits(features, means).drop("department"))
    )


def _counted(hits: DataFrame, *keys: str) -> DataFrame:
    """Hits per suggestion with the first five subject ids.

    Spark trims each map task to five rows per name before the exchange (window
    group limit), so a suggestion that affects a third of all subjects is fine.
    """
    first = Window.partitionBy(*keys).orderBy("subject_id")
    sample = (
        hits.withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= SAMPLE)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("subject_id")).alias("sample_affected"))
    )
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("affected_count")).join(sample, list(keys))


def _finish(rows: DataFrame, priority: Column, impact: Column) -> DataFrame:
    return rows.select(
        "name", "reason", "category", "action", "severity", "base_confidence", "affected_count",
        "total_subjects", "sample_affected", impact.alias("estimated_impact"), priority.alias("priority"),
        "conditions",
    )


def template_suggestions(features: DataFrame) -> DataFrame:
    """Templates that would flag somebody; priority grows with the share affected."""
    rows = [
        (name, "best_practice", category, action, severity, confidence, _rule_json(conditions))
        for name, category, action, severity, confidence, conditions in fixed.POLICY_TEMPLATES
    ]
    catalogue = literal_table(
        features.sparkSession,
        "name string, reason string, category string, action string, severity string, "
        "base_confidence double, conditions string",
        rows,
    )
    counted = (
        _counted(template_hits(features), "name")
        .join(F.broadcast(catalogue), "name")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(estate_facts(features)), "one")
    )
    share = F.col("affected_count") / F.greatest(F.col("total_subjects"), F.lit(1))
    base = F.least(F.lit(1.0), F.lit(0.3) + share * F.lit(0.7))
    priority = F.when(F.col("severity") == "critical", F.least(F.lit(1.0), base + F.lit(0.2))).otherwise(base)
    return _finish(counted, priority, F.format_string("Would flag %d identities", "affected_count"))


def data_driven_suggestions(features: DataFrame) -> DataFrame:
    """Low usage, spanning agents, SoD monitoring and cross-boundary access, where they apply."""
    rows = [
        (name, reason, category, action, severity, confidence, priority, impact, _rule_json(conditions))
        for name, reason, category, action, severity, confidence, priority, impact, conditions in DATA_DRIVEN
    ]
    catalogue = literal_table(
        features.sparkSession,
        "name string, reason string, category string, action string, severity string, "
        "base_confidence double, priority double, impact string, conditions string",
        rows,
    )
    counted = (
        _counted(data_driven_hits(features), "name")
        .join(F.broadcast(catalogue), "name")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(estate_facts(features)), "one")
    )
    share = F.col("affected_count") / F.greatest(F.col("total_subjects"), F.lit(1))
    applies = (
        F.when(F.col("name") == LOW_USAGE, share > 0.1)
        .when(F.col("name") == SOX_MONITORING, F.col("has_erp"))
        .when(F.col("name") == CROSS_BOUNDARY, F.col("has_erp") & F.col("has_cloud"))
        .otherwise(F.lit(True))
    )
    impact = F.replace(F.col("impact"), F.lit("%s"), F.col("affected_count").cast("string"))
    return _finish(counted.where(applies), F.col("priority"), impact)


def department_suggestions(features: DataFrame) -> DataFrame:
    """Departments with unusually many permissions; the rule asks for half as much again."""
    means = materialize(department_means(features), "department-means")
    counted = (
        _counted(department_hits(features, means), "name", "department")
        .join(means, "department")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(estate_facts(features)), "one")
    )
    limit = F.floor(F.col("mean_permissions") * 1.5).cast("bigint")
    rule = F.concat(
        F.lit('[{"feature_name": "department", "operator": "eq", "threshold": "'),
        F.replace(F.col("department"), F.lit('"'), F.lit('\\"')),
        F.lit('"}, {"feature_name": "total_permissions", "operator": "gt", "threshold": '),
        limit.cast("string"),
        F.lit("}]"),
    )
    rows = (
        counted.withColumn("reason", F.lit("pattern_detected"))
        .withColumn("category", F.lit("zero_trust"))
        .withColumn("action", F.lit("flag_for_review"))
        .withColumn("severity", F.lit("medium"))
        .withColumn("base_confidence", F.lit(0.65))
        .withColumn("conditions", rule)
    )
    return _finish(
        rows, F.lit(0.5), F.format_string("Would flag %d identities in %s", "affected_count", "department")
    )


def suggest(features: DataFrame, existing: DataFrame) -> DataFrame:
    """All suggestions whose name no existing policy (column name) has, best first."""
    every = (
        template_suggestions(features)
        .unionByName(data_driven_suggestions(features))
        .unionByName(department_suggestions(features))
    )
    taken = existing.select("name").distinct()
    return skew_join(every, taken, "name", "left_anti").orderBy(F.desc("priority"), "name")
