"""Identity-provider administrator posture: who administers, how they log in, tenant settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.functions.scalars import as_of_lit, entity_id, whole_days
from gatewarden.plans.tables import literal_table
from gatewarden.schemas import Estate, empty_table
from gatewarden.sources.canonical import conform

SOURCE = "okta"
ADMIN = (
    "tenant string, name string, display_name string, role string, mfa_method string, last_login timestamp, "
    "status string, type string, department string, api_token_age_days int"
)
TENANT = "tenant string, session_max_lifetime_hours int, threat_insight_enabled boolean"

# Thresholds and vocabulary.
SUPER_ADMIN = "Super Administrator"
PRIVILEGED_ROLES = ("Super Administrator", "Organization Administrator")
WEAK_FACTORS = ("sms", "email")
DORMANT_DAYS = 90
STALE_TOKEN_DAYS = 90
MAX_SUPER_ADMINS = 5
# Administrator roles -> actions and keywords.
ROLE_ACTIONS = (
    ("Super Administrator",
     ["user.lifecycle.create", "user.lifecycle.delete", "user.account.privilege.grant",
      "system.api_token.create", "system.idp.lifecycle.create", "policy.rule.update",
      "system.log_stream.lifecycle.deactivate"],
     ["identity_admin", "full_tenant_control", "idp_management"]),
    ("Organization Administrator",
     ["user.lifecycle.create", "user.account.privilege.grant", "system.api_token.create", "policy.rule.update"],
     ["identity_admin", "user_management"]),
    ("Application Administrator", ["app.lifecycle.create", "app.user_membership.add"], ["app_management"]),
    ("Help Desk Administrator", ["user.account.reset_password", "user.mfa.factor.reset"],
     ["password_reset", "mfa_reset"]),
    ("Report Administrator", ["system.report.run"], []),
    ("Read Only Administrator", [], []),
)


def _steps(*rows: tuple[str, str, Column]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(a).alias("action"), F.lit(r).alias("resource"), d.alias("description"))
            for a, r, d in rows
        ]
    )


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _finding(rows: DataFrame, kind: str, subject: Column, steps: Column, result: Column, confidence: float):
    return conform(
        rows.select(
            F.concat(F.lit(f"{kind}/"), subject).alias("id"), subject.alias("subject_id"), steps.alias("steps"),
            result.alias("end_result"), F.lit(confidence).alias("confidence"), F.lit(SOURCE).alias("source"),
        ),
        "escalation_path",
    )


def _admin_id() -> Column:
    return entity_id(SOURCE, F.concat(F.lit("admin:"), F.col("name")))


def _tenant_id() -> Column:
    return entity_id(SOURCE, F.concat(F.lit("tenant:"), F.col("tenant")))


def weak_factor_findings(admins: DataFrame) -> DataFrame:
    """Super administrators whose second factor is a text message or mail."""
    rows = admins.where((F.col("role") == SUPER_ADMIN) & F.col("mfa_method").isin(*WEAK_FACTORS))
    method, role = F.col("mfa_method"), F.col("role")
    steps = _steps(
        ("user.authentication.verify", "Okta Admin Console", _text("Authenticates with weak MFA: ", method)),
        ("admin.console.access", "Okta Admin Console", _text("Has ", role, " — full tenant control")),
    )
    result = _text("SuperAdmin with ", method, "-only MFA — phishing/SIM swap can compromise entire tenant")
    return _finding(rows, "weak-mfa", _admin_id(), steps, result, 0.96)


def dormant_admin_findings(admins: DataFrame, as_of: str) -> DataFrame:
    """Active super administrators without a login for more than 90 days."""
    rows = admins.withColumn("idle", whole_days(as_of_lit(as_of), F.col("last_login"))).where(
        (F.col("role") == SUPER_ADMIN) & (F.col("status") == "active") & (F.col("idle") > DORMANT_DAYS)
    )
    steps = _steps(
        ("account.dormant", "Okta Tenant",
         _text("Last login: ", F.col("idle").cast("string"), " days ago — still active")),
        ("privilege.retained", "Okta Admin Console",
         _text("Retains ", F.col("role"), " role — not deprovisioned")),
    )
    result = F.lit("Dormant SuperAdmin — credential stuffing or password spray target")
    return _finding(rows, "dormant", _admin_id(), steps, result, 0.94)


def stale_service_findings(admins: DataFrame) -> DataFrame:
    """Privileged service accounts whose API token is older than 90 days."""
    rows = admins.where(
        (F.col("type") == "service_account")
        & F.col("role").isin(*PRIVILEGED_ROLES)
        & (F.col("api_token_age_days") > STALE_TOKEN_DAYS)
    )
    steps = _steps(
        ("service.account.admin", "Okta Tenant",
         _text("Service account with ", F.col("role"), " — no MFA possible")),
        ("api.token.stale", "Okta API",
         _text("API token age: ", F.col("api_token_age_days").cast("string"), " days — never rotated")),
    )
    result = F.lit("Overprivileged service account with stale API token — mirrors 2023 Okta breach pattern")
    return _finding(rows, "stale-token", _admin_id(), steps, result, 0.97)


def super_admin_counts(admins: DataFrame) -> DataFrame:
    return admins.where(F.col("role") == SUPER_ADMIN).groupBy("tenant").agg(
        F.count(F.lit(1)).alias("super_admins")
    )


def crowded_tenant_findings(admins: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants with more than five super administrators."""
    rows = tenants.join(super_admin_counts(admins), "tenant").where(F.col("super_admins") > MAX_SUPER_ADMINS)
    steps = _steps(
        ("excessive.superadmins", "Okta Tenant",
         _text(F.col("super_admins").cast("string"), " SuperAdmins (recommended: ≤5)")),
        ("weak.session.policy", "Okta Admin Console",
         _text("Admin session lifetime: ", F.col("session_max_lifetime_hours").cast("string"),
               "h (recommended: ≤12h)")),
    )
    result = F.lit("Excessive admin count + permissive session policy — high tenant takeover risk")
    return _finding(rows, "superadmins", _tenant_id(), steps, result, 0.92)


def unguarded_tenant_findings(tenants: DataFrame) -> DataFrame:
    """Tenants without automatic attack detection."""
    rows = tenants.where(~F.coalesce("threat_insight_enabled", F.lit(False)))
    steps = _steps(
        ("threat.insight.disabled", "Okta Tenant",
         F.lit("ThreatInsight is disabled — no automated attack detection")),
        ("asn.binding.disabled", "Okta Admin Console",
         F.lit("Admin session ASN binding disabled — session hijack possible")),
    )
    result = F.lit(
        "No ThreatInsight + no ASN binding — password spray and session hijack attacks will not be auto-blocked"
    )
    return _finding(rows, "threat-insight", _tenant_id(), steps, result, 0.90)


def posture_findings(admins: DataFrame, tenants: DataFrame, as_of: str) -> DataFrame:
    """All posture findings as escalation-path rows."""
    return (
        weak_factor_findings(admins)
        .unionByName(dormant_admin_findings(admins, as_of))
        .unionByName(stale_service_findings(admins))
        .unionByName(crowded_tenant_findings(admins, tenants))
        .unionByName(unguarded_tenant_findings(tenants))
    )


def posture_estate(admins: DataFrame, tenants: DataFrame, as_of: str) -> Estate:
    """Canonical tables of administrator posture data."""
    spark = admins.sparkSession
    roles = literal_table(spark, "role string, actions array<string>, words array<string>", ROLE_ACTIONS)
    console = entity_id(SOURCE, F.lit("app:admin-console"))
    people = admins.select(
        _admin_id().alias("id"), F.col("name").alias("external_id"), F.lit(SOURCE).alias("source"),
        F.when(F.col("type") == "service_account", "service_account").otherwise("human").alias("type"),
        "display_name",
        F.when(F.contains("name", F.lit("@")), F.col("name"))
        .otherwise(F.concat("name", F.lit("@corp.com"))).alias("email"),
        "department", F.lit("active").alias("status"), (F.col("mfa_method") != "none").alias("mfa_enabled"),
        F.col("last_login").alias("last_seen"), as_of_lit(as_of).alias("created_at"),
        F.to_json(
            F.struct(F.col("role").alias("okta_role"), "mfa_method", "api_token_age_days")
        ).alias("attributes"),
    )
    tenant_rows = tenants.select(
        _tenant_id().alias("id"), F.col("tenant").alias("external_id"), F.lit(SOURCE).alias("source"),
        F.lit("service_account").alias("type"), F.lit("Okta Tenant Configuration").alias("display_name"),
        F.lit("IT").alias("department"), F.lit("active").alias("status"), as_of_lit(as_of).alias("created_at"),
    )
    permission = roles.select(
        entity_id(SOURCE, F.concat(F.lit("role:"), F.col("role"))).alias("id"), F.lit(SOURCE).alias("source"),
        F.col("role").alias("name"), F.lit("role").alias("type"), "actions",
        F.col("role").isin(*PRIVILEGED_ROLES).alias("is_privileged"), F.col("words").alias("risk_keywords"),
    )
    grants = admins.join(F.broadcast(roles.select("role")), "role", "left_semi").select(
        F.concat_ws("/", F.lit("admin"), "name").alias("id"), _admin_id().alias("subject_id"),
        entity_id(SOURCE, F.concat(F.lit("role:"), F.col("role"))).alias("permission_id"),
        console.alias("resource_id"), F.lit(SOURCE).alias("source"), F.lit(True).alias("is_active"),
    )
    resource = tenants.select(
        _tenant_id().alias("id"), F.lit(SOURCE).alias("source"), F.lit("okta_tenant").alias("type"),
        F.concat(F.col("tenant"), F.lit(" tenant")).alias("name"), F.lit("critical").alias("sensitivity"),
    ).unionByName(
        literal_table(spark, "name string", [("Okta Admin Console",)]).select(
            console.alias("id"), F.lit(SOURCE).alias("source"), F.lit("okta_application").alias("type"), "name",
            F.lit("critical").alias("sensitivity"),
        )
    )
    return Estate(
        subject=conform(people, "subject").unionByName(conform(tenant_rows, "subject")),
        permission=conform(permission, "permission"),
        resource=conform(resource, "resource"),
        assignment=conform(grants, "assignment"),
        escalation_path=posture_findings(admins, tenants, as_of),
        event=empty_table(spark, "event"),
    )
