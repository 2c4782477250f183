"""Labelling rules for the fifteen violation classes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.functions import fixed_values as fixed
from gatewarden.functions.scalars import as_of_lit, contains_any, erp_key, half_even, is_erp_action, starts_with_any, whole_days
from gatewarden.operators import access, identity, sod
from gatewarden.plans.durable import materialize
from gatewarden.plans.joins import skew_join
from gatewarden.schemas import LABEL_COLUMNS, Estate


@dataclass(frozen=True)
class RuleInputs:
    """What the rules read."""

    estate: Estate
    features: DataFrame
    members: DataFrame
    pairs: DataFrame
    as_of: str


def _evidence(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def _label(
    rows: DataFrame,
    violation_class: int,
    rule_id: Column | str,
    confidence: Column | float,
    evidence: dict[str, Column] | Column,
    sources: Column,
    cross_boundary: Column | bool = False,
) -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    detail = evidence if isinstance(evidence, Column) else _evidence(evidence)
    return rows.select(
        "subject_id",
        F.lit(violation_class).alias("violation_class"),
        F.lit(1).alias("label"),
        as_column(confidence).cast("double").alias("confidence"),
        as_column(rule_id).alias("rule_id"),
        detail.alias("evidence"),
        sources.alias("source_systems"),
        as_column(cross_boundary).alias("is_cross_boundary"),
    )


def _own_source() -> Column:
    return F.array("source")


def _not_groups(features: DataFrame) -> DataFrame:
    return features.where(F.col("type") != "group")


def _people(inputs: RuleInputs, *columns: str) -> DataFrame:
    """Non-group subjects as subject_id plus columns."""
    return inputs.estate.subject.where(F.col("type") != "group").select(
        F.col("id").alias("subject_id"), *columns
    )


# Facts about permissions that rules ask for, one bit each in ``flags``.
FACTS = (
    "code", "money", "admin_group", "config", "security", "financial", "identity", "infrastructure",
    "api", "warehouse_admin", "reports",
)


def _declared_keys() -> Column:
    return F.coalesce("permission_keys", F.array().cast("array<string>"))


def permission_facts(permission: DataFrame) -> DataFrame:
    """One row per permission: its bits, whether it is privileged, its configuration actions and financial keys."""
    declared = F.transform(
        F.filter(_declared_keys(), lambda k: k.isin(*fixed.ERP_ADMIN_KEYS)), lambda k: F.concat(F.lit("netsuite:"), k)
    )
    actions = F.concat("actions", declared)
    name = F.lower("name")
    # Words are matched as substrings, so two-letter words also match inside longer ones.
    text = F.lower(F.concat_ws(" ", "name", F.array_join("actions", " ")))
    category = lambda words: F.col("is_privileged") & contains_any(text, words)
    tests = {
        "code": F.exists("actions", lambda a: starts_with_any(a, ("lambda:", "secretsmanager:"))),
        "money": F.exists("actions", lambda a: is_erp_action(a) & erp_key(a).isin(*fixed.ERP_FINANCIAL_KEYS)),
        "admin_group": (F.col("type") == "group") & contains_any(name, fixed.ADMIN_GROUP_WORDS),
        "config": F.exists(
            actions, lambda a: a.isin(*fixed.CONFIG_ACTIONS) | F.startswith(a, F.lit("netsuite:ADMI_"))
        ),
        "security": category(fixed.SECURITY_WORDS),
        "financial": category(fixed.FINANCIAL_WORDS),
        "identity": category(fixed.IDENTITY_WORDS),
        "infrastructure": category(fixed.INFRASTRUCTURE_WORDS),
        "api": F.exists("actions", lambda a: contains_any(a, ("lambda:", "secretsmanager:", "sts:"))),
        "warehouse_admin": F.contains(name, F.lit("accountadmin")) & F.col("source").isin("snowflake", "aws_iam"),
        "reports": F.array_contains(_declared_keys(), "REPT_FINANCIALS")
        | F.exists("actions", lambda a: F.contains(a, F.lit("REPT_FINANCIALS"))),
    }
    flags = F.lit(0)
    for bit, fact in enumerate(FACTS):
        flags = flags.bitwiseOR(F.when(tests[fact], F.lit(1 << bit)).otherwise(F.lit(0)))
    filled = lambda values: F.when(F.size(values) > 0, values)
    return permission.select(
        F.col("id").alias("permission_id"),
        flags.alias("flags"),
        F.col("is_privileged").cast("int").alias("privileged"),
        filled(
            F.filter(actions, lambda a: a.isin(*fixed.CONFIG_ACTIONS) | F.contains(a, F.lit("ADMI_")))
        ).alias("config_actions"),
        filled(F.filter(_declared_keys(), lambda k: k.isin(*fixed.ERP_FINANCIAL_KEYS))).alias("financial_keys"),
    )


def held_facts(estate: Estate) -> DataFrame:
    """Per subject: the facts of all permissions it holds, in one pass over the held pairs.

    Lists hold what the fixed vocabularies bound; only permissions that have any carry them.
    """
    kept = estate.derived("held_fact")
    if kept is not None:
        return kept
    held = skew_join(access.active_pairs(estate), permission_facts(estate.permission), "permission_id")
    listed = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_set(name)))).alias(name)
    per_subject = held.groupBy("subject_id").agg(
        F.bit_or("flags").alias("flags"),
        F.coalesce(F.sum("privileged"), F.lit(0)).alias("privileged_role_count"),
        listed("config_actions"),
        listed("financial_keys"),
    )
    bits = [(F.col("flags").bitwiseAND(F.lit(1 << bit)) != 0).alias(fact) for bit, fact in enumerate(FACTS)]
    return per_subject.select("subject_id", "privileged_role_count", "config_actions", "financial_keys", *bits)


def assignment_hits(estate: Estate) -> DataFrame:
    """Active assignments that a rule may report: unjustified, of unknown grantor, or break-glass access."""
    kept = estate.derived("assignment_hit")
    if kept is not None:
        return kept
    rows = access.active_with_permission(estate, "name", "is_privileged", "tags")
    rows = rows.withColumns(
        {
            "unjustified": F.col("permission_is_privileged") & (F.coalesce("justification", F.lit("")) == ""),
            "unknown_grantor": F.col("granted_by").isNull() | (F.col("granted_by") == "unknown"),
            "break_glass": is_break_glass(F.col("permission_name"), F.col("permission_tags")),
        }
    )
    return rows.where(F.col("unjustified") | F.col("unknown_grantor") | F.col("break_glass")).select(
        "subject_id", "permission_name", "granted_by", "granted_at", "unjustified", "unknown_grantor", "break_glass"
    )


def _component_flags(inputs: RuleInputs, *facts: str) -> DataFrame:
    """Per member of a correlated identity: facts of what it holds."""
    held = held_facts(inputs.estate).select("subject_id", *facts)
    return (
        inputs.members.select("subject_id", "component_id")
        .join(held, "subject_id", "left")
        .select("component_id", "subject_id", *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in facts])
    )


def _spans(*names: str) -> Column:
    both = F.lit(True)
    for name in names:
        both = both & F.array_contains("sources", name)
    return both


def sod_labels(inputs: RuleInputs) -> DataFrame:
    """Class 1, SOD-R1: every subject of an identity that holds both sides of a pair."""
    rows = sod.sod_violation_members(inputs.estate, inputs.members, inputs.pairs)
    return _label(
        rows, 1, "SOD-R1", F.when(F.col("is_cross_boundary"), 0.85).otherwise(0.95),
        {"sod_pair": F.array("key_a", "key_b"), "sources": F.col("sources")},
        F.col("sources"), F.col("is_cross_boundary"),
    )


def sod_cross_labels(inputs: RuleInputs) -> DataFrame:
    """Class 1, SOD-R1-CROSS: cloud code or secrets together with financial ERP keys."""
    flagged = (
        _component_flags(inputs, "code", "money")
        .groupBy("component_id")
        .agg(F.bool_or("code").alias("code"), F.bool_or("money").alias("money"))
        .where(F.col("code") & F.col("money"))
        .select("component_id")
    )
    rows = skew_join(
        inputs.members.where(_spans("aws_iam", "netsuite")), flagged, "component_id", "left_semi"
    )
    return _label(
        rows, 1, "SOD-R1-CROSS", 0.85,
        {"aws_lambda_access": F.lit(True), "netsuite_financial": F.lit(True)},
        F.col("sources"), True,
    )


def escalation_labels(inputs: RuleInputs) -> DataFrame:
    """Class 2, ESC-R1: escalation paths, except the ERP's and one identity provider's own."""
    paths = inputs.estate.escalation_path.where(~F.col("source").isin("netsuite", "okta"))
    known = inputs.estate.subject.select(F.col("id").alias("subject_id"))
    rows = paths.join(known, "subject_id", "left_semi")
    return _label(
        rows, 2, "ESC-R1", F.col("confidence"),
        {"path_id": F.col("id"), "end_result": F.col("end_result"), "steps": F.size("steps")},
        _own_source(),
    )


def excessive_privilege_labels(inputs: RuleInputs) -> DataFrame:
    """Class 3, EP-R1-HIGH and EP-R1-MED: far above the peer median."""
    ratio = F.col("permission_to_peer_median_ratio")
    rows = _not_groups(inputs.features).where(ratio > 2.0)
    return _label(
        rows, 3,
        F.when(ratio > 3.0, "EP-R1-HIGH").otherwise("EP-R1-MED"),
        F.when(ratio > 3.0, 0.8).otherwise(0.6),
        {"ratio": half_even(ratio, 2), "total_permissions": F.col("total_permissions")},
        _own_source(),
    )


def unused_privilege_labels(inputs: RuleInputs) -> DataFrame:
    """Class 3, EP-R1-UNUSED: many permissions, hardly any used."""
    rows = _not_groups(inputs.features).where(
        (F.col("usage_ratio") < 0.1) & (F.col("total_permissions") > 10)
    )
    return _label(
        rows, 3, "EP-R1-UNUSED", 0.7,
        {"usage_ratio": F.col("usage_ratio"), "total_permissions": F.col("total_permissions")},
        _own_source(),
    )


def dormant_labels(inputs: RuleInputs) -> DataFrame:
    """Class 4, DA-R1-90 and DA-R1-60: privileged but long unseen."""
    days = F.col("days_since_last_activity")
    rows = _not_groups(inputs.features).where((days > 60) & (F.col("privileged_permissions") > 0))
    return _label(
        rows, 4,
        F.when(days > 90, "DA-R1-90").otherwise("DA-R1-60"),
        F.when(days > 90, 0.9).otherwise(0.7),
        {"days_inactive": days, "privileged_permissions": F.col("privileged_permissions")},
        _own_source(),
    )


def _members_with_profile(inputs: RuleInputs, profile: DataFrame) -> DataFrame:
    return skew_join(inputs.members.select("subject_id", "component_id"), profile, "component_id")


def orphan_cross_labels(inputs: RuleInputs) -> DataFrame:
    """Class 5, OA-R1-CROSS: deleted in one system, active in another."""
    profile = identity.inconsistency_profile(inputs.members).where(
        (F.size("deleted_in") > 0) & (F.size("active_in") > 0)
    )
    return _label(
        _members_with_profile(inputs, profile), 5, "OA-R1-CROSS", 0.95,
        {"deleted_in": F.col("deleted_in"), "active_in": F.col("active_in")},
        F.col("sources"), True,
    )


def orphan_inactive_labels(inputs: RuleInputs) -> DataFrame:
    """Class 5, OA-R1-INACTIVE: inactive subject (groups too) with active assignments."""
    active = access.active_assignments(inputs.estate.assignment).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    rows = (
        inputs.estate.subject.where(F.col("status") == "inactive")
        .select(F.col("id").alias("subject_id"), "source")
        .join(active, "subject_id")
    )
    return _label(rows, 5, "OA-R1-INACTIVE", 0.85, {"active_assignments": F.col("n")}, _own_source())


def creep_growth_labels(inputs: RuleInputs) -> DataFrame:
    """Class 6, PC-R1-GROW: only additions over 90 days."""
    rows = _not_groups(inputs.features).where(
        (F.col("permissions_added_90d") > 5) & (F.col("permissions_removed_90d") == 0)
    )
    return _label(
        rows, 6, "PC-R1-GROW", 0.7,
        {"added_90d": F.col("permissions_added_90d"), "removed_90d": F.col("permissions_removed_90d")},
        _own_source(),
    )


def creep_drift_labels(inputs: RuleInputs) -> DataFrame:
    """Class 6, PC-R1-DRIFT: net drift above one fifth."""
    rows = _not_groups(inputs.features).where(F.col("net_drift_rate") > 0.2)
    return _label(
        rows, 6, "PC-R1-DRIFT", 0.8, {"net_drift_rate": half_even(F.col("net_drift_rate"), 3)}, _own_source()
    )


def open_trust_labels(inputs: RuleInputs) -> DataFrame:
    """Class 7, OT-R1-OPEN: anybody may assume the role."""
    rows = inputs.estate.subject.where((F.col("source") == "aws_iam") & F.col("trust_policy_open"))
    return _label(
        rows.withColumn("subject_id", F.col("id")), 7, "OT-R1-OPEN", 0.95,
        {"trust_policy_open": F.lit(True), "principal": F.lit("*")}, _own_source(),
    )


def cross_account_labels(inputs: RuleInputs) -> DataFrame:
    """Class 7, OT-R1-XACCT: foreign accounts trusted without conditions."""
    rows = inputs.estate.subject.where(
        (F.col("source") == "aws_iam")
        & F.col("cross_account_trust")
        & F.col("cross_account_no_conditions")
    )
    return _label(
        rows.withColumn("subject_id", F.col("id")), 7, "OT-R1-XACCT", 0.8,
        {
            "cross_account_trust": F.lit(True),
            "no_conditions": F.lit(True),
            "external_accounts": F.coalesce("cross_account_ids", F.array().cast("array<string>")),
        },
        _own_source(),
    )


def missing_mfa_labels(inputs: RuleInputs) -> DataFrame:
    """Class 8, MFA-R1-PRIV and MFA-R1-ACTIVE: known not to be enrolled (unknown is no hit)."""
    unenrolled = inputs.estate.subject.where(
        (F.col("type") == "human") & (F.col("mfa_enabled") == F.lit(False))
    ).select(F.col("id").alias("subject_id"), "source", "status")
    counts = inputs.features.select("subject_id", "privileged_permissions")
    privileged = F.coalesce("privileged_permissions", F.lit(0)) > 0
    rows = unenrolled.join(counts, "subject_id", "left").where(privileged | (F.col("status") == "active"))
    return _label(
        rows, 8,
        F.when(privileged, "MFA-R1-PRIV").otherwise("MFA-R1-ACTIVE"),
        F.when(privileged, 0.95).otherwise(0.7),
        F.when(
            privileged,
            _evidence({"mfa_enabled": F.lit(False), "privileged_permissions": F.col("privileged_permissions")}),
        ).otherwise(_evidence({"mfa_enabled": F.lit(False)})),
        _own_source(),
    )


def status_mismatch_labels(inputs: RuleInputs) -> DataFrame:
    """Class 9, CSI-R1-STATUS: systems disagree on the status."""
    profile = identity.inconsistency_profile(inputs.members).where(F.col("statuses") > 1)
    return _label(
        _members_with_profile(inputs, profile), 9, "CSI-R1-STATUS", 0.9,
        {"status_by_source": F.col("status_by_source")}, F.col("sources"), True,
    )


def department_mismatch_labels(inputs: RuleInputs) -> DataFrame:
    """Class 9, CSI-R1-DEPT: systems disagree on the department."""
    profile = identity.inconsistency_profile(inputs.members).where(
        (F.col("department_sources") > 1) & (F.col("departments") > 1)
    )
    return _label(
        _members_with_profile(inputs, profile), 9, "CSI-R1-DEPT", 0.5,
        {"department_by_source": F.col("department_by_source")}, F.col("sources_with_department"), True,
    )


def name_mismatch_labels(inputs: RuleInputs) -> DataFrame:
    """Class 9, CSI-R1-NAME: systems disagree on the name."""
    profile = identity.inconsistency_profile(inputs.members).where(F.col("names") > 1)
    return _label(
        _members_with_profile(inputs, profile), 9, "CSI-R1-NAME", 0.3,
        {"name_by_source": F.col("name_by_source")}, F.col("sources"), True,
    )


def _service_accounts(inputs: RuleInputs) -> DataFrame:
    return inputs.features.where(F.col("type") == "service_account")


def service_multi_labels(inputs: RuleInputs) -> DataFrame:
    """Class 10, SA-R1-MULTI: a service account in more than two systems."""
    rows = _service_accounts(inputs).where(F.col("source_system_count") > 2)
    return _label(
        rows, 10, "SA-R1-MULTI", 0.6, {"source_system_count": F.col("source_system_count")}, _own_source()
    )


def service_address_labels(inputs: RuleInputs) -> DataFrame:
    """Class 10, SA-R1-IPS: a service account from more than ten addresses."""
    rows = _service_accounts(inputs).where(F.col("distinct_source_ips_30d") > 10)
    return _label(
        rows, 10, "SA-R1-IPS", 0.7, {"distinct_ips": F.col("distinct_source_ips_30d")}, _own_source()
    )


def service_entropy_labels(inputs: RuleInputs) -> DataFrame:
    """Class 10, SA-R1-ENTROPY: a service account logging in at all hours."""
    rows = _service_accounts(inputs).where(F.col("login_time_entropy") > 3.0)
    return _label(
        rows, 10, "SA-R1-ENTROPY", 0.6,
        {"login_time_entropy": half_even(F.col("login_time_entropy"), 3)}, _own_source(),
    )


def admin_group_members(estate: Estate) -> DataFrame:
    """Subjects holding a group permission whose name speaks of administration."""
    return held_facts(estate).where("admin_group").select("subject_id")


def config_change_labels(inputs: RuleInputs) -> DataFrame:
    """Class 11, UCC-R1: may change configuration but is in no admin group."""
    able = held_facts(inputs.estate).where(F.col("config") & ~F.coalesce("admin_group", F.lit(False)))
    rows = _people(inputs, "source").join(able, "subject_id")
    return _label(
        rows, 11, "UCC-R1", 0.7,
        {"config_actions": F.col("config_actions"), "is_admin_group_member": F.lit(False)},
        _own_source(),
    )


def _justifiable(inputs: RuleInputs) -> DataFrame:
    """Active assignments of the subjects whose systems should record a justification."""
    subjects = _people(inputs, F.col("source").alias("subject_source")).where(
        ~F.col("subject_source").isin("netsuite", "okta")
    )
    return skew_join(assignment_hits(inputs.estate), subjects, "subject_id").withColumn("source", F.col("subject_source"))


def unjustified_labels(inputs: RuleInputs) -> DataFrame:
    """Class 12, ABJ-R1-PRIV: privileged assignment without justification, one row each."""
    rows = _justifiable(inputs).where("unjustified")
    return _label(
        rows, 12, "ABJ-R1-PRIV", 0.6,
        {
            "permission": F.col("permission_name"),
            "is_privileged": F.lit(True),
            "has_justification": F.lit(False),
        },
        _own_source(),
    )


def unknown_grantor_labels(inputs: RuleInputs) -> DataFrame:
    """Class 12, ABJ-R1-UNKNOWN: nobody knows who granted it, one row per assignment."""
    rows = _justifiable(inputs).where("unknown_grantor")
    return _label(
        rows, 12, "ABJ-R1-UNKNOWN", 0.5,
        {"permission": F.col("permission_name"), "granted_by": F.col("granted_by")},
        _own_source(),
    )


def privileged_categories(estate: Estate) -> DataFrame:
    """Per subject: number of privileged permissions and the categories they touch."""
    names = ("security", "financial", "identity", "infrastructure")
    return held_facts(estate).where(F.col("privileged_role_count") > 0).select(
        "subject_id", "privileged_role_count", *names,
        F.array_sort(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("categories"),
    )


def toxic_multi_labels(inputs: RuleInputs) -> DataFrame:
    """Class 13, TRC-R1-MULTI: more than three privileged roles over two or more categories."""
    rows = _people(inputs, "source").join(
        privileged_categories(inputs.estate).where(
            (F.col("privileged_role_count") > 3) & (F.size("categories") >= 2)
        ),
        "subject_id",
    )
    return _label(
        rows, 13, "TRC-R1-MULTI", 0.8,
        {"privileged_role_count": F.col("privileged_role_count"), "categories": F.col("categories")},
        _own_source(),
    )


def toxic_security_finance_labels(inputs: RuleInputs) -> DataFrame:
    """Class 13, TRC-R1-SECFIN: security and financial administration in one hand."""
    rows = _people(inputs, "source").join(
        privileged_categories(inputs.estate).where(F.col("security") & F.col("financial")), "subject_id"
    )
    return _label(
        rows, 13, "TRC-R1-SECFIN", 0.9,
        {"has_security_admin": F.lit(True), "has_financial_admin": F.lit(True)}, _own_source(),
    )


def is_break_glass(name: Column, tags: Column) -> Column:
    pattern = F.lit(fixed.BREAK_GLASS_REGEX)
    by_tag = F.exists(tags, lambda t: F.regexp_like(t, pattern))
    return F.regexp_like(name, pattern) | F.coalesce(by_tag, F.lit(False))


def break_glass_labels(inputs: RuleInputs) -> DataFrame:
    """Class 14, BGA-R1: break-glass access held for two whole days or more."""
    age = F.coalesce(whole_days(as_of_lit(inputs.as_of), F.col("granted_at")), F.lit(0))
    rows = (
        assignment_hits(inputs.estate)
        .where("break_glass")
        .withColumn("age_days", age)
        .where(F.col("age_days") > 1)
    )
    owners = _people(inputs, F.col("source").alias("subject_source"))
    rows = skew_join(rows, owners, "subject_id").withColumn("source", F.col("subject_source"))
    return _label(
        rows, 14, "BGA-R1", 0.9,
        {
            "role": F.col("permission_name"),
            "assignment_age_days": F.col("age_days"),
            "expected_max_hours": F.lit(24),
        },
        _own_source(),
    )


def financial_bypass_labels(inputs: RuleInputs) -> DataFrame:
    """Class 15, CBFB-R1-AWS-NS: cloud API access plus financial ERP keys across systems."""
    per_subject = held_facts(inputs.estate).select("subject_id", "api", F.col("financial_keys").alias("keys"))
    risky = inputs.estate.escalation_path.select("subject_id").distinct().withColumn("risky", F.lit(True))
    spanning = inputs.members.where(_spans("aws_iam", "netsuite"))
    cloud, erp = F.col("source") == "aws_iam", F.col("source") == "netsuite"
    flagged = (
        spanning.select("component_id", "subject_id", "source")
        .join(per_subject, "subject_id", "left")
        .join(risky, "subject_id", "left")
        .select(
            "component_id",
            (cloud & F.coalesce("api", F.lit(False))).alias("api"),
            (cloud & F.coalesce("risky", F.lit(False))).alias("risky"),
            F.explode_outer(F.when(erp, F.col("keys"))).alias("key"),
        )
        .groupBy("component_id")
        .agg(
            F.bool_or("api").alias("api"),
            F.bool_or("risky").alias("escalation"),
            F.array_sort(F.collect_set("key")).alias("financial_keys"),
        )
        .where(F.col("api") & (F.size("financial_keys") > 0))
    )
    rows = skew_join(spanning, flagged, "component_id")
    return _label(
        rows, 15, "CBFB-R1-AWS-NS", F.when(F.col("escalation"), 0.9).otherwise(0.8),
        {
            "aws_api_access": F.col("api"),
            "aws_escalation": F.col("escalation"),
            "netsuite_financial_keys": F.slice("financial_keys", 1, 10),
        },
        F.col("sources"), True,
    )


def warehouse_bypass_labels(inputs: RuleInputs) -> DataFrame:
    """Class 15, CBFB-R1-SF-NS: account administration plus financial reports."""
    flagged = held_facts(inputs.estate).where(F.col("warehouse_admin") & F.col("reports")).select("subject_id")
    rows = inputs.members.join(flagged, "subject_id", "left_semi")
    return _label(
        rows, 15, "CBFB-R1-SF-NS", 0.85,
        {"snowflake_accountadmin": F.lit(True), "netsuite_financial_reports": F.lit(True)},
        F.col("sources"), True,
    )


RULES: dict[str, Callable[[RuleInputs], DataFrame]] = {
    "sod": sod_labels,
    "sod_cross": sod_cross_labels,
    "escalation": escalation_labels,
    "excessive_privilege": excessive_privilege_labels,
    "unused_privilege": unused_privilege_labels,
    "dormant": dormant_labels,
    "orphan_cross": orphan_cross_labels,
    "orphan_inactive": orphan_inactive_labels,
    "creep_growth": creep_growth_labels,
    "creep_drift": creep_drift_labels,
    "open_trust": open_trust_labels,
    "cross_account": cross_account_labels,
    "missing_mfa": missing_mfa_labels,
    "status_mismatch": status_mismatch_labels,
    "department_mismatch": department_mismatch_labels,
    "name_mismatch": name_mismatch_labels,
    "service_multi": service_multi_labels,
    "service_address": service_address_labels,
    "service_entropy": service_entropy_labels,
    "config_change": config_change_labels,
    "unjustified": unjustified_labels,
    "unknown_grantor": unknown_grantor_labels,
    "toxic_multi": toxic_multi_labels,
    "toxic_security_finance": toxic_security_finance_labels,
    "break_glass": break_glass_labels,
    "financial_bypass": financial_bypass_labels,
    "warehouse_bypass": warehouse_bypass_labels,
}


class _Prepared:
    """Rule inputs whose estate carries the stored facts that several rules read."""

    def __init__(self, inputs: RuleInputs):
        self._inputs = inputs
        self.estate = inputs.estate.with_derived(
            held_fact=materialize(held_facts(inputs.estate), "held-facts"),
            assignment_hit=materialize(assignment_hits(inputs.estate), "assignment-hits"),
        )

    def __getattr__(self, name: str):
        return getattr(self._inputs, name)


def label_all(inputs: RuleInputs) -> DataFrame:
    """All rules' labels, one row per hit. A rule that fails, fails the job.

    Held permissions and assignments are joined with the permissions once each.
    """
    prepared = _Prepared(inputs)
    result = None
    for rule in RULES.values():
        rows = rule(prepared).select(*LABEL_COLUMNS)
        result = rows if result is None else result.unionByName(rows)
    return result
