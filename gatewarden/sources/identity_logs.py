"""Identity-provider logs: system log, directory audits and sign-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewarden.functions.scalars import fixed_map, iso_timestamp
from gatewarden.sources.cloudtrail import _blank, _finish, in_range
from gatewarden.sources.files import log_manifest, read_by_manifest

OKTA = "okta_syslog"
OKTA_EVENT = (
    "uuid string, eventType string, published string, "
    "actor struct<id:string,alternateId:string,displayName:string,type:string>, "
    "target array<struct<id:string,alternateId:string,type:string,displayName:string>>, "
    "client struct<ipAddress:string,userAgent:struct<rawUserAgent:string>,"
    "geographicalContext:struct<city:string,country:string>>, "
    "outcome struct<result:string,reason:string>, authenticationContext struct<externalSessionId:string>"
)
# System-log event types.
OKTA_TYPES = {
    "user.session.start": "auth.login",
    "user.session.end": "auth.logout",
    "user.authentication.auth_via_mfa": "auth.mfa_success",
    "user.authentication.verify": "auth.mfa_challenge",
    "user.mfa.factor.activate": "auth.mfa_success",
    "user.mfa.factor.deactivate": "auth.mfa_failure",
    "user.authentication.sso": "auth.login",
    "user.authentication.auth_via_IDP": "auth.login",
    "policy.evaluate_sign_on": "auth.login",
    "user.lifecycle.create": "iam.create_user",
    "user.lifecycle.delete.initiated": "iam.delete_user",
    "user.lifecycle.deactivate": "iam.modify_user",
    "user.lifecycle.activate": "iam.modify_user",
    "user.lifecycle.suspend": "iam.modify_user",
    "user.lifecycle.unsuspend": "iam.modify_user",
    "user.account.update_profile": "iam.modify_user",
    "user.account.update_password": "auth.password_change",
    "user.account.reset_password": "auth.password_change",
    "group.user_membership.add": "group.add_member",
    "group.user_membership.remove": "group.remove_member",
    "application.user_membership.add": "app.user_assigned",
    "application.user_membership.remove": "app.user_unassigned",
    "app.generic.unauth_app_access_attempt": "app.access",
    "user.authentication.auth_via_social": "auth.login",
    "application.lifecycle.create": "resource.create",
    "application.lifecycle.delete": "resource.delete",
    "application.lifecycle.update": "resource.modify",
    "policy.lifecycle.create": "iam.config_change",
    "policy.lifecycle.update": "iam.config_change",
    "policy.lifecycle.delete": "iam.config_change",
    "policy.rule.create": "iam.config_change",
    "policy.rule.update": "iam.config_change",
    "policy.rule.delete": "iam.config_change",
    "system.org.rate_limit.warning": "unknown",
    "system.org.rate_limit.violation": "unknown",
    "user.account.privilege.grant": "iam.attach_policy",
    "user.account.privilege.revoke": "iam.detach_policy",
}
OKTA_PRIVILEGED = (
    "user.account.privilege.grant",
    "user.account.privilege.revoke",
    "user.lifecycle.create",
    "user.lifecycle.delete.initiated",
    "application.lifecycle.create",
    "application.lifecycle.delete",
    "policy.lifecycle.create",
    "policy.lifecycle.update",
    "policy.lifecycle.delete",
    "user.account.reset_password",
    "group.user_membership.add",
    "group.user_membership.remove",
)
OKTA_CONFIG = (
    "policy.lifecycle.create",
    "policy.lifecycle.update",
    "policy.lifecycle.delete",
    "policy.rule.create",
    "policy.rule.update",
    "policy.rule.delete",
    "application.lifecycle.create",
    "application.lifecycle.update",
    "application.lifecycle.delete",
)

ENTRA = "entra_audit"
_PARTY = "id:string,userPrincipalName:string,displayName:string"
ENTRA_AUDIT = (
    "id string, activityDisplayName string, activityDateTime string, "
    f"initiatedBy struct<user:struct<{_PARTY}>,app:struct<servicePrincipalId:string,appId:string,displayName:string>>, "
    f"targetResources array<struct<{_PARTY},type:string>>, result string, resultReason string, correlationId string"
)
ENTRA_SIGN_IN = (
    "id string, createdDateTime string, status struct<errorCode:int,failureReason:string>, "
    "mfaDetail struct<authMethod:string,authDetail:string>, authenticationMethodsUsed array<string>, "
    "location struct<city:string,state:string,countryOrRegion:string>, "
    "deviceDetail struct<operatingSystem:string,browser:string>, userPrincipalName string, userId string, "
    "userDisplayName string, ipAddress string, appDisplayName string, resourceId string, "
    "resourceDisplayName string, correlationId string"
)
# Directory audit activities.
ENTRA_TYPES = {
    "Add user": "iam.create_user",
    "Delete user": "iam.delete_user",
    "Update user": "iam.modify_user",
    "Disable account": "iam.modify_user",
    "Enable account": "iam.modify_user",
    "Reset user password": "auth.password_change",
    "Change user password": "auth.password_change",
    "Set force change user password": "auth.password_change",
    "Add member to group": "group.add_member",
    "Remove member from group": "group.remove_member",
    "Add group": "resource.create",
    "Delete group": "resource.delete",
    "Update group": "resource.modify",
    "Add member to role": "iam.attach_policy",
    "Remove member from role": "iam.detach_policy",
    "Add eligible member to role": "iam.attach_policy",
    "Remove eligible member from role": "iam.detach_policy",
    "Add scoped member to role": "iam.attach_policy",
    "Add application": "resource.create",
    "Delete application": "resource.delete",
    "Update application": "resource.modify",
    "Add service principal": "iam.create_user",
    "Delete service principal": "iam.delete_user",
    "Update service principal": "iam.modify_user",
    "Add app role assignment grant to user": "app.user_assigned",
    "Remove app role assignment from user": "app.user_unassigned",
    "Add app role assignment to service principal": "app.user_assigned",
    "Add policy": "iam.config_change",
    "Delete policy": "iam.config_change",
    "Update policy": "iam.config_change",
    "Set Company Information": "iam.config_change",
    "Update authorization policy": "iam.config_change",
    "Add service principal credentials": "iam.create_access_key",
    "Remove service principal credentials": "iam.config_change",
    "Update application – Certificates and secrets management": "iam.create_access_key",
    "Consent to application": "app.user_assigned",
    "Add delegated permission grant": "iam.attach_policy",
    "Add app role assignment grant to service principal": "iam.attach_policy",
}
ENTRA_PRIVILEGED = (
    "Add member to role",
    "Remove member from role",
    "Add eligible member to role",
    "Add user",
    "Delete user",
    "Add service principal credentials",
    "Add delegated permission grant",
    "Add app role assignment grant to service principal",
    "Consent to application",
    "Update authorization policy",
    "Add policy",
    "Delete policy",
)
ENTRA_CONFIG = (
    "Add policy",
    "Delete policy",
    "Update policy",
    "Set Company Information",
    "Update authorization policy",
    "Update application – Certificates and secrets management",
    "Add service principal credentials",
    "Remove service principal credentials",
)


# --- readers ------------------------------------------------------------------------


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines log files below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def okta_log(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """System-log events in a closed time range, in no order."""
    return in_range(read_json_log(spark, path, OKTA_EVENT), "published", since, until)


def entra_audit_log(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    return in_range(read_json_log(spark, path, ENTRA_AUDIT), "activityDateTime", since, until)


def entra_sign_in_log(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    return in_range(read_json_log(spark, path, ENTRA_SIGN_IN), "createdDateTime", since, until)


# Feed: event schema and the column with an event's time.
FEEDS = {
    "okta": (OKTA_EVENT, "published"),
    "entra_audit": (ENTRA_AUDIT, "activityDateTime"),
    "entra_sign_in": (ENTRA_SIGN_IN, "createdDateTime"),
}


def manifest_of(spark: SparkSession, path: str, feed: str, known: DataFrame | None = None) -> DataFrame:
    """Manifest rows of a feed's files that ``known`` lacks (see ``files.log_manifest``)."""
    return log_manifest(spark, path, feed, *FEEDS[feed], known)


def read_range(spark: SparkSession, manifest: DataFrame, feed: str, since: str, until: str) -> DataFrame:
    """A feed's events in a closed time range, from the files that overlap it."""
    return read_by_manifest(spark, manifest, feed, *FEEDS[feed], since, until)


def parse_json(rows: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """One JSON event per row."""
    return rows.select(F.from_json(column, schema).alias("r")).select("r.*")


# --- normalisation --------------------------------------------------------------------


def _dated(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("timestamp", iso_timestamp(F.col(column))).where(F.col("timestamp").isNotNull())


def _event_id(source: str, column: str) -> Column:
    return F.concat(F.lit(f"{source}/"), _blank(column))


def normalise_okta(events: DataFrame) -> DataFrame:
    """System-log events; unknown types and undated rows are dropped, the type filter first."""
    kind = F.coalesce(fixed_map(OKTA_TYPES)[F.col("eventType")], F.lit("unknown"))
    config = F.coalesce(F.col("eventType").isin(*OKTA_CONFIG), F.lit(False))
    system = F.startswith(_blank("eventType"), F.lit("system."))
    kept = events.withColumn("kind", kind).where(config | (~system & (F.col("kind") != "unknown")))
    actor = F.coalesce("actor.alternateId", "actor.id", F.lit(""))
    target = F.try_element_at("target", F.lit(1))
    target_id = F.coalesce(target["alternateId"], target["id"], F.lit(""))
    success = _blank("outcome.result") == "SUCCESS"
    city, country = _blank("client.geographicalContext.city"), _blank("client.geographicalContext.country")
    rows = _dated(kept, "published").select(
        _event_id(OKTA, "uuid").alias("id"), F.lit(OKTA).alias("source"), _blank("uuid").alias("source_event_id"),
        F.col("kind").alias("event_type"), F.col("eventType").alias("raw_event_name"), "timestamp",
        actor.alias("actor_id"), F.coalesce("actor.displayName", actor).alias("actor_display_name"),
        F.when(F.coalesce("actor.type", F.lit("User")) == "User", "human").otherwise("service_account")
        .alias("actor_type"),
        target_id.alias("target_id"), F.coalesce(target["type"], F.lit("")).alias("target_type"),
        F.coalesce(target["displayName"], target_id).alias("target_name"),
        _blank("client.ipAddress").alias("source_ip"),
        _blank("client.userAgent.rawUserAgent").alias("user_agent"),
        F.when(city != "", F.concat(city, F.lit(", "), country)).otherwise(country).alias("geo_location"),
        _blank("authenticationContext.externalSessionId").alias("session_id"),
        success.alias("success"), F.when(success, "").otherwise("FAILURE").alias("error_code"),
        _blank("outcome.reason").alias("error_message"),
        F.col("eventType").isin(*OKTA_PRIVILEGED).alias("is_privileged_action"),
        F.col("eventType").isin(*OKTA_CONFIG).alias("is_config_change"),
        F.lit(False).alias("is_cross_boundary"),
        F.to_json(F.struct(*[c for c in events.columns])).alias("raw_payload"),
    )
    return _finish(rows)


def normalise_entra_audit(events: DataFrame) -> DataFrame:
    """Directory audits; unknown activities that change no configuration are dropped."""
    name = F.col("activityDisplayName")
    kind = F.coalesce(fixed_map(ENTRA_TYPES)[name], F.lit("unknown"))
    kept = events.withColumn("kind", kind).where(
        (F.col("kind") != "unknown") | F.coalesce(name.isin(*ENTRA_CONFIG), F.lit(False))
    )
    user, app = F.col("initiatedBy.user"), F.col("initiatedBy.app")
    by_user, by_app = user.isNotNull(), app.isNotNull()
    user_id = F.coalesce(user["userPrincipalName"], user["id"], F.lit(""))
    app_id = F.coalesce(app["servicePrincipalId"], app["appId"], F.lit(""))
    target = F.try_element_at("targetResources", F.lit(1))
    target_id = F.coalesce(target["id"], target["userPrincipalName"], F.lit(""))
    success = _blank("result") == "success"
    rows = _dated(kept, "activityDateTime").select(
        _event_id(ENTRA, "id").alias("id"), F.lit(ENTRA).alias("source"), _blank("id").alias("source_event_id"),
        F.col("kind").alias("event_type"), name.alias("raw_event_name"), "timestamp",
        F.when(by_user, user_id).when(by_app, app_id).otherwise("").alias("actor_id"),
        F.when(by_user, F.coalesce(user["displayName"], user_id))
        .when(by_app, F.coalesce(app["displayName"], app_id)).otherwise("").alias("actor_display_name"),
        F.when(~by_user & by_app, "service_account").otherwise("human").alias("actor_type"),
        target_id.alias("target_id"), F.coalesce(target["type"], F.lit("")).alias("target_type"),
        F.coalesce(target["displayName"], target_id).alias("target_name"),
        F.lit("").alias("source_ip"), F.lit("").alias("user_agent"), F.lit("").alias("geo_location"),
        _blank("correlationId").alias("session_id"), success.alias("success"),
        F.when(success, "").otherwise(_blank("resultReason")).alias("error_code"),
        _blank("resultReason").alias("error_message"),
        name.isin(*ENTRA_PRIVILEGED).alias("is_privileged_action"),
        name.isin(*ENTRA_CONFIG).alias("is_config_change"), F.lit(False).alias("is_cross_boundary"),
        F.to_json(F.struct(*[c for c in events.columns])).alias("raw_payload"),
    )
    return _finish(rows)


def normalise_entra_sign_in(events: DataFrame) -> DataFrame:
    """Sign-ins; with MFA details they are MFA successes or failures, else logins."""
    code = F.coalesce("status.errorCode", F.lit(0))
    success = code == 0
    detail = F.coalesce("mfaDetail.authMethod", "mfaDetail.authDetail").isNotNull()
    methods = F.coalesce(F.size("authenticationMethodsUsed"), F.lit(0)) > 0
    app = _blank("appDisplayName")
    blank = F.lit("")
    rows = _dated(events, "createdDateTime").select(
        _event_id(ENTRA, "id").alias("id"), F.lit(ENTRA).alias("source"), _blank("id").alias("source_event_id"),
        F.when(detail | methods, F.when(success, "auth.mfa_success").otherwise("auth.mfa_failure"))
        .otherwise("auth.login").alias("event_type"),
        F.concat(F.lit("signIn:"), F.coalesce(F.nullif(app, blank), F.lit("unknown"))).alias("raw_event_name"),
        "timestamp", F.coalesce("userPrincipalName", "userId", blank).alias("actor_id"),
        _blank("userDisplayName").alias("actor_display_name"), F.lit("human").alias("actor_type"),
        _blank("resourceId").alias("target_id"), F.lit("application").alias("target_type"),
        F.coalesce(F.nullif("resourceDisplayName", blank), app).alias("target_name"),
        _blank("ipAddress").alias("source_ip"),
        F.trim(
            F.concat(_blank("deviceDetail.operatingSystem"), F.lit(" "), _blank("deviceDetail.browser"))
        ).alias("user_agent"),
        F.concat_ws(
            ", ",
            F.nullif("location.city", blank), F.nullif("location.state", blank),
            F.nullif("location.countryOrRegion", blank),
        ).alias("geo_location"),
        _blank("correlationId").alias("session_id"), success.alias("success"),
        F.when(success, "").otherwise(code.cast("string")).alias("error_code"),
        _blank("status.failureReason").alias("error_message"),
        F.lit(False).alias("is_privileged_action"), F.lit(False).alias("is_config_change"),
        F.lit(False).alias("is_cross_boundary"),
        F.to_json(F.struct(*[c for c in events.columns])).alias("raw_payload"),
    )
    return _finish(rows)
