"""Identity-provider directory exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.functions.scalars import contains_any, entity_id, fixed_map, iso_timestamp
from gatewarden.operators.access import first_by
from gatewarden.plans.joins import skew_join
from gatewarden.schemas import Estate, empty_table
from gatewarden.sources.canonical import conform

NO_STRINGS = "array<string>"

# --- Entra -------------------------------------------------------------------

ENTRA = "entra"
# Directory roles that count as privileged.
ENTRA_PRIVILEGED_ROLES = (
    "Global Administrator",
    "Privileged Role Administrator",
    "Exchange Administrator",
    "SharePoint Administrator",
    "Application Administrator",
    "User Administrator",
    "Security Administrator",
    "Compliance Administrator",
    "Intune Administrator",
    "Cloud Application Administrator",
    "Authentication Administrator",
    "Helpdesk Administrator",
    "Conditional Access Administrator",
)
ENTRA_AGENT_WORDS = ("agent", "ai", "llm", "copilot")

ENTRA_SCHEMAS = {
    "users": "id string, displayName string, userPrincipalName string, mail string, userType string, "
    "accountEnabled boolean, department string, jobTitle string, lastSignInDateTime string, createdDateTime string",
    "service_principals": "id string, displayName string, appId string, servicePrincipalType string, "
    "accountEnabled boolean, tags array<string>",
    "groups": "id string, displayName string, description string, groupTypes array<string>, "
    "securityEnabled boolean, mailEnabled boolean",
    "roles": "id string, displayName string, description string, roleTemplateId string",
    "role_members": "role_id string, member_id string",
    "member_of": "user_id string, target_id string",
    "applications": "id string, displayName string, appId string, createdDateTime string",
    "app_role_assignments": "user_id string, appRoleId string, resourceId string, resourceDisplayName string, "
    "createdDateTime string",
}
OKTA_SCHEMAS = {
    "users": "id string, status string, created string, lastLogin string, lastUpdated string, "
    "profile struct<firstName:string,lastName:string,email:string,login:string,department:string,"
    "managerId:string,userType:string,title:string>",
    "groups": "id string, type string, profile struct<name:string,description:string>",
    "user_groups": "user_id string, group_id string",
    "apps": "id string, label string, name string, signOnMode string, status string",
    "app_links": "user_id string, appInstanceId string, id string, appName string, label string",
    "roles": "user_id string, type string, label string, created string",
    "factors": "user_id string, factorType string, status string",
}


def read_export(spark, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """One JSON-lines table per export, each in a subfolder of its name."""
    return {name: spark.read.schema(ddl).json(f"{folder}/{name}") for name, ddl in schemas.items()}


def _status(enabled: str) -> Column:
    return F.when(F.coalesce(enabled, F.lit(True)), "active").otherwise("inactive")


def _grant(rows: DataFrame, source: str, *extra: Column) -> DataFrame:
    """Assignment rows from (subject_id, permission_id) and extra columns."""
    return conform(
        rows.select(
            F.concat_ws("/", "subject_id", "permission_id").alias("id"), "subject_id", "permission_id",
            F.lit(source).alias("source"), F.lit(True).alias("is_active"), *extra,
        ),
        "assignment",
    )


def entra_users(users: DataFrame) -> DataFrame:
    uid = F.col("id")
    kind = F.coalesce("userType", F.lit("Member"))
    return conform(
        users.select(
            entity_id(ENTRA, uid).alias("id"), uid.alias("external_id"), F.lit(ENTRA).alias("source"),
            F.lit("human").alias("type"), F.coalesce("displayName", uid).alias("display_name"),
            F.coalesce(F.nullif("mail", F.lit("")), "userPrincipalName").alias("email"), "department",
            _status("accountEnabled").alias("status"),
            iso_timestamp(F.col("lastSignInDateTime")).alias("last_seen"),
            F.to_json(
                F.struct(
                    kind.alias("user_type"), F.col("jobTitle").alias("job_title"),
                    F.col("userPrincipalName").alias("upn"), (kind == "Guest").alias("is_guest"),
                )
            ).alias("attributes"),
            iso_timestamp(F.col("createdDateTime")).alias("created_at"),
        ),
        "subject",
    )


def entra_service_principals(principals: DataFrame) -> DataFrame:
    """Applications' identities; agents by name or tag."""
    pid = F.col("id")
    tags = F.coalesce("tags", F.array().cast(NO_STRINGS))
    agent = contains_any(F.lower(F.coalesce("displayName", F.lit(""))), ENTRA_AGENT_WORDS) | F.exists(
        tags, lambda t: F.contains(F.lower(t), F.lit("agent"))
    )
    return conform(
        principals.select(
            entity_id(ENTRA, pid).alias("id"), pid.alias("external_id"), F.lit(ENTRA).alias("source"),
            F.when(agent, "ai_agent").otherwise("service_account").alias("type"),
            F.coalesce("displayName", pid).alias("display_name"), _status("accountEnabled").alias("status"),
            F.to_json(
                F.struct(F.col("appId").alias("app_id"), F.col("servicePrincipalType").alias("sp_type"), "tags")
            ).alias("attributes"),
        ),
        "subject",
    )


def entra_groups(groups: DataFrame) -> DataFrame:
    gid = F.col("id")
    return conform(
        groups.select(
            entity_id(ENTRA, gid).alias("id"), gid.alias("external_id"), F.lit(ENTRA).alias("source"),
            F.lit("group").alias("type"), F.coalesce("displayName", gid).alias("display_name"),
            F.lit("active").alias("status"),
            F.to_json(
                F.struct(
                    "description", F.col("groupTypes").alias("group_types"),
                    F.coalesce("securityEnabled", F.lit(False)).alias("security_enabled"),
                    F.coalesce("mailEnabled", F.lit(False)).alias("mail_enabled"),
                )
            ).alias("attributes"),
        ),
        "subject",
    )


def entra_roles(roles: DataFrame) -> DataFrame:
    name = F.coalesce("displayName", F.lit(""))
    admin = F.contains(F.lower(name), F.lit("administrator"))
    return conform(
        roles.select(
            entity_id(ENTRA, F.col("id")).alias("id"), F.lit(ENTRA).alias("source"), name.alias("name"),
            F.lit("role").alias("type"), F.array(name).alias("actions"),
            name.isin(*ENTRA_PRIVILEGED_ROLES).alias("is_privileged"),
            F.when(admin, F.array(F.lit("admin"))).otherwise(F.array().cast(NO_STRINGS)).alias("risk_keywords"),
            F.to_json(F.struct(F.col("roleTemplateId").alias("role_template_id"), "description")).alias(
                "attributes"
            ),
        ),
        "permission",
    )


def entra_app_roles(assignments: DataFrame) -> DataFrame:
    """App-role grants: subject_id, permission columns, granted_at."""
    blank = F.lit("")
    return assignments.select(
        entity_id(ENTRA, F.col("user_id")).alias("subject_id"),
        entity_id(
            ENTRA,
            F.concat(
                F.lit("approle:"), F.coalesce("appRoleId", blank), F.lit(":"), F.coalesce("resourceId", blank)
            ),
        ).alias("id"),
        F.lit(ENTRA).alias("source"),
        F.concat(F.lit("AppRole-"), F.coalesce("resourceDisplayName", F.lit("unknown"))).alias("name"),
        F.lit("entitlement").alias("type"),
        F.lit(False).alias("is_privileged"),
        iso_timestamp(F.col("createdDateTime")).alias("granted_at"),
    )


def entra_estate(export: dict[str, DataFrame]) -> Estate:
    """Canonical tables of one Entra export."""
    role_grants = skew_join(
        export["role_members"], export["roles"].select(F.col("id").alias("role_id")), "role_id", "left_semi"
    ).select(
        entity_id(ENTRA, F.col("member_id")).alias("subject_id"),
        entity_id(ENTRA, F.col("role_id")).alias("permission_id"),
    )
    memberships = export["member_of"].select(
        entity_id(ENTRA, F.col("user_id")).alias("subject_id"),
        entity_id(ENTRA, F.col("target_id")).alias("permission_id"),
    )
    app_roles = entra_app_roles(export["app_role_assignments"])
    applications = conform(
        export["applications"].select(
            entity_id(ENTRA, F.col("id")).alias("id"), F.lit(ENTRA).alias("source"),
            F.lit("entra_application").alias("type"), F.coalesce("displayName", "id").alias("name"),
            F.lit("medium").alias("sensitivity"),
            F.to_json(F.struct(F.col("appId").alias("app_id"))).alias("attributes"),
        ),
        "resource",
    )
    spark = export["users"].sparkSession
    entitlement = first_by(app_roles.drop("subject_id", "granted_at"), ["id"], [F.col("name")])
    return Estate(
        subject=entra_users(export["users"])
        .unionByName(entra_service_principals(export["service_principals"]))
        .unionByName(entra_groups(export["groups"])),
        permission=entra_roles(export["roles"]).unionByName(conform(entitlement, "permission")),
        resource=applications,
        assignment=_grant(role_grants, ENTRA)
        .unionByName(_grant(memberships, ENTRA, F.lit(ENTRA).alias("granted_by")))
        .unionByName(
            _grant(app_roles.withColumn("permission_id", F.col("id")), ENTRA, F.col("granted_at"))
        ),
        escalation_path=empty_table(spark, "escalation_path"),
        event=empty_table(spark, "event"),
    )


# --- Okta ----------------------------------------------------------------------

OKTA = "okta"
# Account states and administrator role types.
OKTA_STATUS = {
    "ACTIVE": "active",
    "STAGED": "inactive",
    "PROVISIONED": "active",
    "SUSPENDED": "suspended",
    "DEPROVISIONED": "deleted",
    "LOCKED_OUT": "suspended",
    "PASSWORD_EXPIRED": "active",
    "RECOVERY": "active",
}
OKTA_ADMIN_ROLES = (
    "SUPER_ADMIN",
    "ORG_ADMIN",
    "APP_ADMIN",
    "USER_ADMIN",
    "HELP_DESK_ADMIN",
    "READ_ONLY_ADMIN",
    "MOBILE_ADMIN",
    "API_ACCESS_MANAGEMENT_ADMIN",
    "REPORT_ADMIN",
    "GROUP_MEMBERSHIP_ADMIN",
)
OKTA_CRITICAL_APPS = ("aws", "azure", "gcp", "vault", "okta")
OKTA_HIGH_APPS = ("slack", "jira", "github", "salesforce")
OKTA_PRIVILEGED_GROUPS = ("admin", "super", "owner", "privileged")


def okta_users(users: DataFrame) -> DataFrame:
    uid, blank = F.col("id"), F.lit("")
    full = F.trim(
        F.concat(F.coalesce("profile.firstName", blank), F.lit(" "), F.coalesce("profile.lastName", blank))
    )
    state = F.coalesce("status", F.lit("ACTIVE"))
    service = F.lower(F.coalesce("profile.userType", blank)) == "service"
    return conform(
        users.select(
            entity_id(OKTA, uid).alias("id"), uid.alias("external_id"), F.lit(OKTA).alias("source"),
            F.when(service, "service_account").otherwise("human").alias("type"),
            F.coalesce(F.nullif(full, blank), uid).alias("display_name"),
            F.col("profile.email").alias("email"), F.col("profile.department").alias("department"),
            F.col("profile.managerId").alias("manager_id"),
            F.coalesce(fixed_map(OKTA_STATUS)[state], F.lit("active")).alias("status"),
            iso_timestamp(F.col("lastLogin")).alias("last_seen"), F.lit(False).alias("mfa_enabled"),
            F.to_json(
                F.struct(
                    F.col("profile.login").alias("login"), F.col("profile.title").alias("title"),
                    state.alias("okta_status"),
                )
            ).alias("attributes"),
            iso_timestamp(F.col("created")).alias("created_at"),
            iso_timestamp(F.col("lastUpdated")).alias("updated_at"),
        ),
        "subject",
    )


def okta_groups(groups: DataFrame) -> DataFrame:
    name = F.coalesce("profile.name", "id")
    admin = F.contains(F.lower(name), F.lit("admin"))
    return conform(
        groups.select(
            entity_id(OKTA, F.col("id")).alias("id"), F.lit(OKTA).alias("source"), name.alias("name"),
            F.lit("group").alias("type"),
            contains_any(F.lower(name), OKTA_PRIVILEGED_GROUPS).alias("is_privileged"),
            F.when(admin, F.array(F.lit("admin"))).otherwise(F.array().cast(NO_STRINGS)).alias("risk_keywords"),
            F.to_json(
                F.struct(
                    F.coalesce("type", F.lit("OKTA_GROUP")).alias("group_type"),
                    F.col("profile.description").alias("description"),
                )
            ).alias("attributes"),
        ),
        "permission",
    )


def app_sensitivity(name: Column) -> Column:
    text = F.lower(name)
    return (
        F.when(contains_any(text, OKTA_CRITICAL_APPS), "critical")
        .when(contains_any(text, OKTA_HIGH_APPS), "high")
        .otherwise("medium")
    )


def okta_apps(apps: DataFrame) -> DataFrame:
    name = F.coalesce("label", "name", "id")
    return conform(
        apps.select(
            entity_id(OKTA, F.col("id")).alias("id"), F.lit(OKTA).alias("source"),
            F.lit("okta_application").alias("type"), name.alias("name"),
            app_sensitivity(name).alias("sensitivity"),
            F.to_json(
                F.struct(F.lower(F.coalesce("signOnMode", F.lit(""))).alias("sign_on_mode"), "status")
            ).alias("attributes"),
        ),
        "resource",
    )


def okta_admin_roles(roles: DataFrame) -> DataFrame:
    """Administrator role grants: subject_id, permission columns, granted_at."""
    kind = F.coalesce("type", F.lit("UNKNOWN"))
    admin = F.contains(kind, F.lit("ADMIN"))
    return roles.select(
        entity_id(OKTA, F.col("user_id")).alias("subject_id"),
        entity_id(OKTA, F.concat(F.lit("role:"), kind)).alias("id"), F.lit(OKTA).alias("source"),
        F.coalesce("label", kind).alias("name"), F.lit("role").alias("role_kind"), F.array(kind).alias("actions"),
        kind.isin(*OKTA_ADMIN_ROLES).alias("is_privileged"),
        F.when(admin, F.array(F.lit("admin"))).otherwise(F.array().cast(NO_STRINGS)).alias("risk_keywords"),
        F.to_json(F.struct(kind.alias("role_type"))).alias("attributes"),
        iso_timestamp(F.col("created")).alias("granted_at"),
    ).withColumnRenamed("role_kind", "type")


def with_factors(subject: DataFrame, factors: DataFrame) -> DataFrame:
    """MFA flag, number and kinds of active factors for human users."""
    active = (
        factors.where(F.col("status") == "ACTIVE")
        .groupBy(F.col("user_id").alias("external_id"))
        .agg(F.count(F.lit(1)).alias("factors"), F.array_sort(F.collect_set("factorType")).alias("kinds"))
    )
    human = F.col("type") == "human"
    count = F.coalesce("factors", F.lit(0).cast("bigint"))
    detail = F.to_json(
        F.struct(
            count.alias("mfa_factor_count"),
            F.coalesce("kinds", F.array().cast(NO_STRINGS)).alias("mfa_factor_types"),
            F.col("attributes").alias("profile"),
        )
    )
    return (
        subject.join(active, "external_id", "left")
        .withColumn("mfa_enabled", F.when(human, count > 0).otherwise(F.col("mfa_enabled")))
        .withColumn("attributes", F.when(human, detail).otherwise(F.col("attributes")))
        .select(*subject.columns)
    )


def okta_app_links(links: DataFrame) -> DataFrame:
    """App links: each is its own entitlement, limited to the app."""
    app = F.coalesce("appInstanceId", "id", F.lit(""))
    return links.select(
        entity_id(OKTA, F.col("user_id")).alias("subject_id"),
        entity_id(OKTA, F.concat(F.lit("applink:"), F.col("user_id"), F.lit(":"), app)).alias("permission_id"),
        entity_id(OKTA, app).alias("resource_id"),
        F.concat(F.lit("App-"), F.coalesce("appName", "label", F.lit("unknown"))).alias("name"),
        F.to_json(F.struct(app.alias("app_instance_id"), "label")).alias("attributes"),
    )


def okta_estate(export: dict[str, DataFrame]) -> Estate:
    """Canonical tables of one Okta export."""
    links = okta_app_links(export["app_links"])
    roles = okta_admin_roles(export["roles"])
    group_grants = skew_join(
        export["user_groups"], export["groups"].select(F.col("id").alias("group_id")), "group_id", "left_semi"
    ).select(
        entity_id(OKTA, F.col("user_id")).alias("subject_id"),
        entity_id(OKTA, F.col("group_id")).alias("permission_id"),
    )
    entitlements = conform(
        links.select(
            F.col("permission_id").alias("id"), F.lit(OKTA).alias("source"), "name",
            F.lit("entitlement").alias("type"), F.lit(False).alias("is_privileged"), "attributes",
        ),
        "permission",
    )
    spark = export["users"].sparkSession
    distinct_roles = first_by(roles.drop("subject_id", "granted_at"), ["id"], [F.col("name")])
    return Estate(
        subject=with_factors(okta_users(export["users"]), export["factors"]),
        permission=okta_groups(export["groups"])
        .unionByName(entitlements)
        .unionByName(conform(distinct_roles, "permission")),
        resource=okta_apps(export["apps"]),
        assignment=_grant(group_grants, OKTA)
        .unionByName(_grant(links, OKTA, F.col("resource_id")))
        .unionByName(_grant(roles.withColumn("permission_id", F.col("id")), OKTA, F.col("granted_at"))),
        escalation_path=empty_table(spark, "escalation_path"),
        event=empty_table(spark, "event"),
    )
