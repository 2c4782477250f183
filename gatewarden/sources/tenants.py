"""Health-tenant and trading-firm documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewarden.functions.scalars import as_of_lit, entity_id, fixed_map
from gatewarden.plans.joins import skew_join
from gatewarden.plans.tables import literal_table
from gatewarden.schemas import Estate, empty_table, nested
from gatewarden.sources.canonical import conform
from gatewarden.sources.finding_steps import steps_of

ENTITY = (
    "id string, name string, role string, department string, facility string, desk string, type string, "
    "status string, last_login_days_ago int, mfa boolean, contract_end string, termination_date string, "
    "notes string, violation_injected string, series_licenses array<string>, years_experience int, "
    "coverage string, mnpi_access boolean"
)
VIOLATION = (
    "id string, type string, subject_id string, description string, severity string, confidence double, "
    "evidence string"
)


RULE_COLUMNS = "type string, rule_id string, name string, regulation string, severity string, violation_class int"

# =============================== health tenant ========================================

HEALTH = "healthcare"
HEALTH_ROLE = "role string, actions array<string>, scope string, is_privileged boolean, description string"
HEALTH_DOCUMENT = (
    "organization struct<facilities:array<struct<id:string,name:string,type:string,departments:array<string>>>>, "
    f"fhir_rbac_roles array<{nested(HEALTH_ROLE)}>, providers array<{nested(ENTITY)}>, "
    f"contractors array<{nested(ENTITY)}>, ai_agents array<{nested(ENTITY)}>, "
    f"injected_violations array<{nested(VIOLATION)}>"
)
# Finding type -> rule, title, regulation, severity, class.
HEALTH_RULES = (
    ("unauthorized_record_access", "HIPAA-R1-UNAUTH-ACCESS", "Unauthorized PHI Access",
     "§164.502(a) — Minimum Necessary", "critical", 15),
    ("peer_deviation", "HIPAA-R2-PEER-DEVIATION", "Anomalous Access Volume",
     "§164.312(b) — Audit Controls", "high", 6),
    ("break_glass_abuse", "HIPAA-R3-BREAKGLASS-ABUSE", "Break-Glass Abuse",
     "§164.312(a)(1) — Access Control", "critical", 14),
    ("dormant_contractor", "HIPAA-R4-DORMANT-CONTRACTOR", "Dormant Contractor / Vendor Access",
     "§164.308(a)(3)(ii)(A) — Workforce Clearance", "high", 4),
    ("ai_agent_scope_drift", "HIPAA-R5-AGENT-SCOPE-DRIFT", "AI Agent Scope Drift",
     "§164.502(b) — Minimum Necessary", "critical", 10),
    ("cross_system_aggregation", "HIPAA-R6-CROSS-SYSTEM", "Cross-System PHI Aggregation",
     "§164.502(b) — Minimum Necessary", "high", 9),
    ("missing_mfa", "HIPAA-R7-MISSING-MFA", "PHI Access Without MFA",
     "§164.312(d) — Person or Entity Authentication", "medium", 8),
    ("excessive_export", "HIPAA-R8-EXCESSIVE-EXPORT", "Excessive Data Export",
     "§164.312(b) — Audit Controls", "high", 11),
    ("celebrity_snooping", "HIPAA-R9-CELEBRITY-SNOOP", "VIP Record Snooping",
     "§164.502(a) — Minimum Necessary", "high", 15),
)
# Finding type -> steps (action, resource, description template).
HEALTH_STEPS = {
    "unauthorized_record_access": (
        ("Access PHI Outside Role Scope", "EHR Clinical Notes", "Accessed {records_accessed|restricted records}"),
        ("Minimum Necessary Violation", "Psychiatry Records (42 CFR Part 2)",
         "Business need: {business_need|None documented}"),
    ),
    "peer_deviation": (
        ("Excessive Record Access", "EHR Clinical Notes",
         "Accessed {records_accessed_30d|N/A} records in 30 days (peer median: {peer_median_30d|N/A})"),
        ("Cross-Department Access", "Multiple Departments", "Departments: {departments_accessed[]}"),
    ),
    "break_glass_abuse": (
        ("Break-Glass Emergency Override", "EHR Access Control",
         "Used {break_glass_uses_30d|N/A} times in 30 days (peer avg: {peer_break_glass_avg|N/A})"),
        ("Access Without Justification", "VIP Patient Records",
         "Justifications provided: {justifications_provided|0} — accessed: {patients_accessed[]}"),
    ),
    "dormant_contractor": (
        ("Dormant Credential Active", "Healthcare Systems",
         "Contract ended {contract_end_date|unknown} — {days_since_contract_end|N/A} days ago"),
        ("Active PHI Permissions", "EHR / Clinical Systems",
         "Active permissions: {active_permissions[]}. MFA: {mfa_enabled?enabled:DISABLED}"),
    ),
    "ai_agent_scope_drift": (
        ("AI Agent Cross-Department Access", "EHR Clinical Notes",
         "Accessed departments: {departments_accessed[]}. Expected: {expected_scope|N/A}"),
        ("Historical Record Access Beyond Scope", "Patient Records",
         "Read {historical_records_read|0} historical records vs {active_encounter_records|0} active encounter records"),
        ("42 CFR Part 2 Access by AI Agent", "Psychiatry Records",
         "{risk_note|AI agent accessing protected mental health records}"),
    ),
    "cross_system_aggregation": (
        ("Cross-System PHI Access", "Multiple Clinical Systems", "Systems accessed: {systems_accessed[]}"),
        ("Patient Profile Reconstruction Risk", "Aggregated PHI",
         "Can correlate clinical + billing + pharmacy data. {unique_patients_accessed_30d|0} patients accessed in 30 days"),
    ),
    "missing_mfa": (
        ("PHI Access Without MFA", "Healthcare Systems",
         "Role: {role|N/A} — PHI access level: {phi_access_level|N/A}"),
    ),
    "excessive_export": (
        ("Excessive Bulk Data Export", "FHIR Server / EHR",
         "Performed {bulk_exports_30d|0} exports in 30 days (peer avg: {peer_avg_exports_30d|0})"),
        ("Data Exfiltration Risk", "Patient Data",
         "{records_exported|0} records exported. Destinations: {export_destinations[]}"),
    ),
    "celebrity_snooping": (
        ("VIP Record Access", "Patient Records",
         "Accessed {patient_type|VIP} record — care team member: {care_team_member|False}"),
        ("Access Outside Clinical Need", "Patient Records",
         "Department match: {department_match|False}. Duration: {access_duration|N/A}. Time: {access_time|N/A}"),
    ),
}
# Clinical systems, department tiers, extra roles, role keywords.
HEALTH_SYSTEMS = (
    ("EHR Clinical Notes", "clinical_system", "critical"),
    ("FHIR Server", "clinical_system", "critical"),
    ("Pharmacy Dispensing", "pharmacy_system", "high"),
    ("Billing System", "billing_system", "high"),
    ("Lab Results", "clinical_system", "high"),
    ("Radiology PACS", "clinical_system", "high"),
    ("Patient Portal", "patient_facing", "medium"),
    ("Research Data Warehouse", "research_system", "high"),
    ("Audit Log System", "security_system", "critical"),
)
PROTECTED_DEPARTMENTS = ("Psychiatry", "Substance Abuse", "Adolescent Psych")
ACUTE_DEPARTMENTS = ("Oncology", "ICU", "Surgery", "Emergency")
BREAK_GLASS_HOLDERS = ("Attending Physician", "IT System Admin")
BREAK_GLASS_ROLE = "Break-Glass Emergency"
CODER_AGENT = "AI-CODER-001"
CODER_EXTRA_ROLES = ("Billing Clerk", "Clinical Staff")
HEALTH_KEYWORDS = (
    (("admin", "system"), "admin_access"),
    (("export",), "data_export"),
    (("break", "emergency"), "break_glass"),
    (("psychiatry", "restricted"), "42cfr_part2"),
    (("pharmacy",), "controlled_substance"),
    (("ai", "scribe", "triage", "coder"), "ai_agent"),
    (("privileged", "contributor"), "write_access"),
    (("billing",), "phi_billing"),
    (("him", "information management"), "release_of_info"),
)


def _any_word(text: Column, words) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _subject_type(kind: Column) -> Column:
    return F.when(kind.isin("ai_agent", "service_account"), kind).otherwise("human")


def read_health(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """facilities, roles, entities (with ``origin``) and violations of health documents."""
    documents = spark.read.schema(HEALTH_DOCUMENT).option("multiLine", True).json(path)
    entities = None
    for origin, column in (("provider", "providers"), ("contractor", "contractors"), ("agent", "ai_agents")):
        part = documents.select(F.inline(column)).withColumn("origin", F.lit(origin))
        entities = part if entities is None else entities.unionByName(part)
    return {
        "facilities": documents.select(F.inline("organization.facilities")),
        "roles": documents.select(F.inline("fhir_rbac_roles")),
        "entities": entities,
        "violations": documents.select(F.inline("injected_violations")),
    }


def last_seen(days_ago: Column, as_of: str) -> Column:
    return as_of_lit(as_of) - F.make_dt_interval(F.coalesce(days_ago, F.lit(0)))


def health_subjects(entities: DataFrame, as_of: str) -> DataFrame:
    """People, contractors and agents. Creation is unknown and taken as ``as_of``."""
    kind = _subject_type(F.coalesce("type", F.lit("human")))
    name = F.lower("name")
    local = F.replace(F.replace(F.replace(name, F.lit(" "), F.lit(".")), F.lit(",")), F.lit(".rn"))
    return conform(
        entities.select(
            entity_id(HEALTH, F.concat(F.lit("entity:"), F.col("id"))).alias("id"),
            F.col("id").alias("external_id"), F.lit(HEALTH).alias("source"), kind.alias("type"),
            F.col("name").alias("display_name"),
            F.when(kind == "human", F.concat(local, F.lit("@apexhealth.org")))
            .otherwise(F.concat(F.lower("id"), F.lit("@agents.apexhealth.org"))).alias("email"),
            F.coalesce("department", F.lit("")).alias("department"),
            F.when(F.coalesce("status", F.lit("active")) == "active", "active").otherwise("inactive").alias("status"),
            F.col("mfa").alias("mfa_enabled"),
            last_seen(F.col("last_login_days_ago"), as_of).alias("last_seen"),
            as_of_lit(as_of).alias("created_at"),
            F.to_json(
                F.struct(
                    F.coalesce("facility", F.lit("")).alias("facility"), F.col("role").alias("role_title"),
                    "contract_end", "notes", F.col("violation_injected").alias("violation_type"),
                )
            ).alias("attributes"),
        ),
        "subject",
    )


def department_sensitivity(department: Column) -> Column:
    return (
        F.when(department.isin(*PROTECTED_DEPARTMENTS), "critical")
        .when(department.isin(*ACUTE_DEPARTMENTS), "high")
        .otherwise("medium")
    )


def health_resources(facilities: DataFrame) -> DataFrame:
    """Facilities, their departments and the data systems."""
    places = facilities.select(
        F.concat(F.lit("facility:"), F.col("id")).alias("key"), F.lit("healthcare_facility").alias("type"),
        "name", F.lit("high").alias("sensitivity"),
        F.to_json(F.struct(F.col("type").alias("facility_type"), "departments")).alias("attributes"),
    )
    departments = facilities.select("id", "name", F.explode("departments").alias("department")).select(
        F.concat(F.lit("dept:"), F.col("id"), F.lit(":"), F.col("department")).alias("key"),
        F.lit("healthcare_department").alias("type"),
        F.concat(F.col("department"), F.lit(" — "), F.col("name")).alias("name"),
        department_sensitivity(F.col("department")).alias("sensitivity"),
        F.to_json(
            F.struct(
                F.col("id").alias("facility_id"), "department",
                F.col("department").isin(*PROTECTED_DEPARTMENTS).alias("has_42cfr_data"),
            )
        ).alias("attributes"),
    )
    return _as_resources(places.unionByName(departments), HEALTH_SYSTEMS, HEALTH)


def _as_resources(rows: DataFrame, systems, source: str) -> DataFrame:
    fixed = literal_table(rows.sparkSession, "name string, type string, sensitivity string", systems).select(
        F.concat(F.lit("system:"), F.col("name")).alias("key"), "type", "name", "sensitivity",
        F.lit("{}").alias("attributes"),
    )
    return conform(
        rows.unionByName(fixed).withColumn("id", entity_id(source, F.col("key"))).withColumn(
            "source", F.lit(source)
        ),
        "resource",
    )


def health_role_keywords(role: Column) -> Column:
    text = F.lower(role)
    return F.array_compact(F.array(*[F.when(_any_word(text, w), F.lit(k)) for w, k in HEALTH_KEYWORDS]))


def health_permissions(roles: DataFrame) -> DataFrame:
    return conform(
        roles.select(
            entity_id(HEALTH, F.concat(F.lit("role:"), F.col("role"))).alias("id"), F.lit(HEALTH).alias("source"),
            F.col("role").alias("name"), F.lit("role").alias("type"), "actions", "is_privileged",
            health_role_keywords(F.col("role")).alias("risk_keywords"),
            F.to_json(F.struct("scope", "description")).alias("attributes"),
        ),
        "permission",
    )


def _role_grants(entities: DataFrame, granted: Column, roles: DataFrame, source: str) -> DataFrame:
    """Assignments of the roles in the array ``granted``; unknown roles drop out."""
    listed = entities.select(F.col("id").alias("entity"), F.explode(F.array_distinct(granted)).alias("role"))
    known = skew_join(listed, roles.select("role").distinct(), "role", "left_semi")
    return conform(
        known.select(
            entity_id(source, F.concat(F.lit("entity:"), F.col("entity"))).alias("subject_id"),
            entity_id(source, F.concat(F.lit("role:"), F.col("role"))).alias("permission_id"),
        ).select(
            F.concat_ws("/", "subject_id", "permission_id").alias("id"), "subject_id", "permission_id",
            F.lit(source).alias("source"), F.lit(True).alias("is_active"),
        ),
        "assignment",
    )


def health_assignments(entities: DataFrame, roles: DataFrame) -> DataFrame:
    """Each entity's role, break-glass for some providers, extra roles for the coding agent."""
    role = F.col("role")
    granted = (
        F.when((F.col("origin") == "provider") & role.isin(*BREAK_GLASS_HOLDERS), F.array(role, F.lit(BREAK_GLASS_ROLE)))
        .when(
            (F.col("origin") == "agent") & (F.col("id") == CODER_AGENT),
            F.array(role, *[F.lit(r) for r in CODER_EXTRA_ROLES]),
        )
        .otherwise(F.array(role))
    )
    return _role_grants(entities, granted, roles, HEALTH)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return literal_table(spark, RULE_COLUMNS, rules)


def violation_rules(violations: DataFrame, rules) -> DataFrame:
    """Violations with rule id, title, regulation and class; unknown types drop out."""
    facts = rule_table(violations.sparkSession, rules).withColumnRenamed("severity", "rule_severity").withColumnRenamed(
        "name", "rule_name"
    )
    return skew_join(violations, facts, "type")


def _findings(violations: DataFrame, entities: DataFrame, rules, templates, system: str, source: str) -> DataFrame:
    known = skew_join(
        violation_rules(violations, rules), entities.select(F.col("id").alias("subject_id")), "subject_id", "left_semi"
    )
    fallback = F.array(
        F.struct(
            F.col("rule_name").alias("action"), F.lit(system).alias("resource"),
            F.col("description").alias("description"),
        )
    )
    return conform(
        known.select(
            "id",
            entity_id(source, F.concat(F.lit("entity:"), F.col("subject_id"))).alias("subject_id"),
            steps_of(F.col("type"), F.col("evidence"), templates, fallback).alias("steps"),
            F.col("description").alias("end_result"), "confidence", F.lit(source).alias("source"),
        ),
        "escalation_path",
    )


def health_findings(violations: DataFrame, entities: DataFrame) -> DataFrame:
    return _findings(violations, entities, HEALTH_RULES, HEALTH_STEPS, "Healthcare Systems", HEALTH)


def health_estate(tables: dict[str, DataFrame], as_of: str) -> Estate:
    """Canonical tables of health documents."""
    spark = tables["entities"].sparkSession
    return Estate(
        subject=health_subjects(tables["entities"], as_of),
        permission=health_permissions(tables["roles"]),
        resource=health_resources(tables["facilities"]),
        assignment=health_assignments(tables["entities"], tables["roles"]),
        escalation_path=health_findings(tables["violations"], tables["entities"]),
        event=empty_table(spark, "event"),
    )


# =============================== trading firm ==========================================

TRADING = "trading"
TRADING_ROLE = (
    "role string, actions array<string>, scope string, is_privileged boolean, desk_access array<string>, "
    "mnpi_access boolean, chinese_wall boolean, restricted_trading boolean, is_agent boolean"
)
TRADING_DOCUMENT = (
    "firm struct<desks:array<struct<id:string,name:string,division:string,asset_class:string,"
    "is_restricted:boolean,restriction_note:string>>,information_barriers:array<struct<id:string,name:string,"
    "side_a:array<string>,side_b:array<string>,regulation:string,description:string>>>, "
    f"finserv_rbac_roles array<{nested(TRADING_ROLE)}>, personnel array<{nested(ENTITY)}>, "
    f"terminated_personnel array<{nested(ENTITY)}>, ai_agents array<{nested(ENTITY)}>, "
    f"injected_violations array<{nested(VIOLATION)}>"
)
# Finding type -> rule, title, regulation, severity, class.
TRADING_RULES = (
    ("chinese_wall_breach", "FINRA-R1-CHINESE-WALL", "Chinese Wall Breach",
     "FINRA Rule 2241 — Research Analyst Conflicts", "critical", 15),
    ("block_trade_front_running", "SEC-R2-FRONT-RUNNING", "Block Trade Front-Running",
     "SEC Rule 10b-5 / FINRA Rule 5270", "critical", 15),
    ("mnpi_access", "SEC-R3-MNPI", "MNPI Access / Disclosure", "SEC Rule 10b-5 / Regulation FD", "critical", 15),
    ("compliance_trading_violation", "FINRA-R4-COMP-TRADING", "Compliance Personal Trading",
     "FINRA Rule 3110 / Rule 3210", "critical", 1),
    ("cross_desk_access", "FINRA-R5-CROSS-DESK", "Cross-Desk Unauthorized Access",
     "FINRA Rule 3110 — Supervision", "high", 13),
    ("dormant_terminated", "FINRA-R6-DORMANT", "Dormant / Terminated Access",
     "FINRA Rule 4511 / Rule 3110", "critical", 4),
    ("ai_agent_scope_drift", "SEC-R7-AGENT-SCOPE", "AI Agent MNPI Scope Drift",
     "SEC Rule 10b-5 (agent analogue) / FINRA Rule 5270", "critical", 10),
    ("ai_chinese_wall_breach", "FINRA-R8-AGENT-WALL", "AI Agent Chinese Wall Breach",
     "FINRA Rule 2241 (agent analogue)", "high", 10),
    ("excessive_trading_access", "FINRA-R9-OPS-SOD", "Operations SoD Violation",
     "FINRA Rule 3110 / SOX ITGC", "high", 1),
    ("missing_mfa_trading", "SEC-R10-MISSING-MFA", "Trading Account Without MFA",
     "SEC Regulation S-P / FINRA cybersecurity guidance", "high", 8),
)
# Finding type -> steps (action, resource, description template).
TRADING_STEPS = {
    "chinese_wall_breach": (
        ("Chinese Wall Breach", "{restricted_resource|Research System}",
         "Barrier crossed: {information_barrier|N/A}. {access_type|}"),
        ("Trading After Access", "Order Management System",
         "Timing: {timing|N/A}. {trading_activity_post_access|}"),
    ),
    "block_trade_front_running": (
        ("Block Order Book Access", "Block Order Book",
         "Barrier: {information_barrier|N/A}. {access_type|}"),
        ("Front-Running Trade Execution", "Order Management System", "Timing: {timing|N/A}"),
        ("Profit from MNPI", "Trading P&L",
         "Estimated profit: {profit_estimate|N/A}. {morgan_stanley_parallel|}"),
    ),
    "mnpi_access": (
        ("MNPI Access", "{restricted_resource|Block Order Book}",
         "Barrier: {information_barrier|N/A}. {access_type|}"),
        ("MNPI Disclosure to Client", "Communications",
         "Flagged communication: {communication_flagged|N/A}. Clients notified: {clients_notified|0}"),
    ),
    "compliance_trading_violation": (
        ("Compliance Officer Trading", "Restricted List / Personal Trading",
         "Manages restricted list AND executed personal trades. Securities: {restricted_securities_traded[]}"),
        ("SoD Violation — Compliance + Trading", "Personal Brokerage Account",
         "Personal trades in 30d: {personal_trades_30d|0} (peer avg: {peer_personal_trades_avg|0}). "
         "Account: {trading_account|N/A}"),
    ),
    "cross_desk_access": (
        ("Cross-Desk Position Access", "Multiple Trading Desks",
         "Primary desk: {primary_desk|N/A}. Additional access: {additional_access[]}"),
        ("Information Arbitrage Risk", "P&L / Risk System",
         "Risk: {risk|N/A}. Justification: {justification_on_file?on file:NONE}"),
    ),
    "dormant_terminated": (
        ("Dormant Credential Active", "Trading Systems",
         "Terminated {termination_date|unknown} — {days_since_termination|N/A} days ago. "
         "Last activity: {last_activity|N/A}"),
        ("Active Trading Permissions", "Order Management System",
         "Active permissions: {active_permissions[]}. MFA: {mfa_enabled?enabled:DISABLED}. {risk|}"),
    ),
    "ai_agent_scope_drift": (
        ("AI Agent Cross-Barrier Access", "Block Order Book / Client Flow",
         "Assigned desk: {assigned_desk|N/A}. Unauthorized access: {unauthorized_access[]}"),
        ("Information Barrier Crossed by AI", "{information_barrier_crossed|Information Barrier}",
         "Expected scope: {expected_scope|N/A}. Orders suggested after access: {orders_suggested_after_access|0}"),
        ("Automated Front-Running Risk", "Order Management System",
         "{risk|AI agent with MNPI access — automated front-running risk}"),
    ),
    "ai_chinese_wall_breach": (
        ("AI Agent Chinese Wall Breach", "Trading Desk Positions / P&L",
         "Assigned desk: {assigned_desk|N/A}. Unauthorized access: {unauthorized_access[]}"),
        ("Research Bias Risk", "Research Portal",
         "Barrier crossed: {information_barrier_crossed|N/A}. Reports drafted after access: "
         "{research_reports_drafted_after_access|0}. {risk|}"),
    ),
    "excessive_trading_access": (
        ("Toxic Permission Combination", "Settlement System", "Permissions: {toxic_combination[]}"),
        ("SoD Violation — Amend + Approve + Settle", "Operations Systems",
         "Amendments in 30d: {amendments_30d|0} (peer avg: {peer_amendments_avg|0}). "
         "Exceptions approved: {exceptions_approved_30d|0}. {risk|}"),
    ),
    "missing_mfa_trading": (
        ("Trading Access Without MFA", "Trading Systems",
         "Role: {role|N/A}. Access: {access_level|N/A}. MFA: DISABLED. Status: {account_status|N/A}"),
    ),
}
# Trading systems, desks' departments, the trader with extra desks.
TRADING_SYSTEMS = (
    ("Order Management System", "trading_system", "critical"),
    ("Block Order Book", "trading_system", "critical"),
    ("Market Data Feed", "market_data", "medium"),
    ("Research Portal", "research_system", "high"),
    ("Trade Blotter", "surveillance_system", "critical"),
    ("Communications Surveillance", "surveillance_system", "critical"),
    ("Restricted List", "compliance_system", "critical"),
    ("P&L / Risk System", "risk_system", "high"),
    ("Settlement System", "operations_system", "high"),
    ("Audit Trail", "compliance_system", "critical"),
    ("Client Flow Data", "trading_system", "critical"),
)
DESK_DEPARTMENTS = {
    "DESK-EQ": "Equities Trading",
    "DESK-FI": "Fixed Income Trading",
    "DESK-BLOCK": "Block Trading",
    "DESK-DERIV": "Derivatives",
    "DESK-SALES": "Institutional Sales",
    "DESK-RES": "Equity Research",
    "DESK-RISK": "Risk Management",
    "DESK-COMP": "Compliance",
    "DESK-OPS": "Operations",
    "DESK-IT": "Technology",
}
DEFAULT_DESK_DEPARTMENT = "Trading"
MULTI_DESK_TRADER = "TRAD-006"
MULTI_DESK_ROLES = ("Trader — Equities", "Trader — Fixed Income")


def read_trading(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """desks, barriers, roles, entities (with ``origin``) and violations of trading documents."""
    documents = spark.read.schema(TRADING_DOCUMENT).option("multiLine", True).json(path)
    entities = None
    for origin, column in (("active", "personnel"), ("terminated", "terminated_personnel"), ("agent", "ai_agents")):
        part = documents.select(F.inline(column)).withColumn("origin", F.lit(origin))
        entities = part if entities is None else entities.unionByName(part)
    return {
        "desks": documents.select(F.inline("firm.desks")),
        "barriers": documents.select(F.inline("firm.information_barriers")),
        "roles": documents.select(F.inline("finserv_rbac_roles")),
        "entities": entities,
        "violations": documents.select(F.inline("injected_violations")),
    }


def trading_subjects(entities: DataFrame, as_of: str) -> DataFrame:
    kind = _subject_type(F.coalesce("type", F.lit("human")))
    local = F.replace(F.replace(F.lower("name"), F.lit(" "), F.lit(".")), F.lit(","))
    return conform(
        entities.select(
            entity_id(TRADING, F.concat(F.lit("entity:"), F.col("id"))).alias("id"),
            F.col("id").alias("external_id"), F.lit(TRADING).alias("source"), kind.alias("type"),
            F.col("name").alias("display_name"),
            F.when(kind == "human", F.concat(local, F.lit("@apexcapital.com")))
            .otherwise(F.concat(F.lower("id"), F.lit("@agents.apexcapital.com"))).alias("email"),
            F.coalesce(fixed_map(DESK_DEPARTMENTS)[F.col("desk")], F.lit(DEFAULT_DESK_DEPARTMENT)).alias("department"),
            F.when(F.coalesce("status", F.lit("active")) == "active", "active").otherwise("inactive").alias("status"),
            F.col("mfa").alias("mfa_enabled"),
            last_seen(F.col("last_login_days_ago"), as_of).alias("last_seen"),
            as_of_lit(as_of).alias("created_at"),
            F.to_json(
                F.struct(
                    F.coalesce("desk", F.lit("")).alias("desk"), F.col("role").alias("role_title"),
                    "series_licenses", "years_experience", "coverage", "mnpi_access", "termination_date", "notes",
                    F.col("violation_injected").alias("violation_type"),
                )
            ).alias("attributes"),
        ),
        "subject",
    )


def desk_sensitivity(restricted: Column, division: Column) -> Column:
    return (
        F.when(F.coalesce(restricted, F.lit(False)), "critical")
        .when(division == "front-office", "high")
        .otherwise("medium")
    )


def trading_resources(desks: DataFrame, barriers: DataFrame) -> DataFrame:
    """Desks, information barriers (critical controls) and trading systems."""
    desk_rows = desks.select(
        F.concat(F.lit("desk:"), F.col("id")).alias("key"), F.lit("trading_desk").alias("type"), "name",
        desk_sensitivity(F.col("is_restricted"), F.col("division")).alias("sensitivity"),
        F.to_json(
            F.struct(
                "division", "asset_class", F.coalesce("is_restricted", F.lit(False)).alias("is_restricted"),
                F.coalesce("restriction_note", F.lit("")).alias("restriction_note"),
            )
        ).alias("attributes"),
    )
    barrier_rows = barriers.select(
        F.concat(F.lit("barrier:"), F.col("id")).alias("key"), F.lit("information_barrier").alias("type"), "name",
        F.lit("critical").alias("sensitivity"),
        F.to_json(F.struct("side_a", "side_b", "regulation", "description")).alias("attributes"),
    )
    return _as_resources(desk_rows.unionByName(barrier_rows), TRADING_SYSTEMS, TRADING)


def trading_role_keywords() -> Column:
    """Keywords of a trading role row, in their fixed order."""
    text = F.lower("role")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    executes = F.exists(
        F.coalesce("actions", F.array().cast("array<string>")), lambda a: F.contains(a, F.lit("execute"))
    )
    marks = (
        (executes, "order_execution"),
        (flag("mnpi_access"), "mnpi_access"),
        (flag("chinese_wall"), "chinese_wall_restricted"),
        (flag("restricted_trading"), "restricted_trading"),
        (flag("is_agent"), "ai_agent"),
        (flag("is_privileged"), "privileged_access"),
        (_any_word(text, ("admin",)), "admin_access"),
        (_any_word(text, ("compliance",)), "compliance_access"),
        (_any_word(text, ("research",)), "research_silo"),
        (_any_word(text, ("block",)), "block_trading"),
        (_any_word(text, ("risk",)), "risk_management"),
        (_any_word(text, ("settlement", "operations")), "operations"),
    )
    return F.array_compact(F.array(*[F.when(hit, F.lit(word)) for hit, word in marks]))


def trading_permissions(roles: DataFrame) -> DataFrame:
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    return conform(
        roles.select(
            entity_id(TRADING, F.concat(F.lit("role:"), F.col("role"))).alias("id"),
            F.lit(TRADING).alias("source"), F.col("role").alias("name"), F.lit("role").alias("type"), "actions",
            flag("is_privileged"), trading_role_keywords().alias("risk_keywords"),
            F.to_json(
                F.struct(
                    "scope", "desk_access", flag("chinese_wall"), flag("mnpi_access"),
                    flag("restricted_trading"), flag("is_agent"),
                )
            ).alias("attributes"),
        ),
        "permission",
    )


def trading_assignments(entities: DataFrame, roles: DataFrame) -> DataFrame:
    """Each entity's role; one trader also holds two other desks' roles."""
    role = F.col("role")
    granted = F.when(
        F.col("id") == MULTI_DESK_TRADER, F.array(role, *[F.lit(r) for r in MULTI_DESK_ROLES])
    ).otherwise(F.array(role))
    return _role_grants(entities, granted, roles, TRADING)


def trading_findings(violations: DataFrame, entities: DataFrame) -> DataFrame:
    return _findings(violations, entities, TRADING_RULES, TRADING_STEPS, "Trading Systems", TRADING)


def trading_estate(tables: dict[str, DataFrame], as_of: str) -> Estate:
    """Canonical tables of trading documents."""
    spark = tables["entities"].sparkSession
    return Estate(
        subject=trading_subjects(tables["entities"], as_of),
        permission=trading_permissions(tables["roles"]),
        resource=trading_resources(tables["desks"], tables["barriers"]),
        assignment=trading_assignments(tables["entities"], tables["roles"]),
        escalation_path=trading_findings(tables["violations"], tables["entities"]),
        event=empty_table(spark, "event"),
    )
