"""Readers and normalisers over payloads derived from the tables."""

from pyspark.sql import functions as F

from gatewarden import bind
from gatewarden.functions.scalars import entity_id, iso_timestamp
from gatewarden.operators import findings
from gatewarden.operators.peers import peer_department
from gatewarden.sources import cloud_iam, cloudtrail, directories, erp, identity_logs, posture, tables, tenants
from gatewarden.plans.durable import durable_root
from verification import payloads
from verification.binding_sql import AS_OF, EVENT_AS_OF, days
from verification.registry import case, joined, r6

ISO = "date_trunc('second', ts)"


def listed(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TRAIL = {"trail": f"""
SELECT *, event_id AS n, {listed(payloads.TRAIL_NAMES)}[event_id % 13 + 1] AS name,
 {listed(payloads.TRAIL_SERVICES)}[event_id % 7 + 1] AS service, {listed(payloads.TRAIL_KINDS)}[event_id % 6 + 1] AS kind,
 {listed(payloads.TRAIL_PARAMS)}[event_id % 9 + 1] AS param, 'arn:x/T' || (event_id % 100) AS pv,
 CASE WHEN event_id % 4 <> 1 THEN 'U' || user_id END AS uname,
 CASE WHEN event_id % 5 = 0 THEN 'Agent-' ELSE 'deploy' END || user_id AS role FROM events"""}


def service_columns(no_target: str) -> str:
    """What the service profile makes of a record; ``no_target`` tells where the parameters name none."""
    return f"""'ev-' || n AS source_event_id, service || ':' || name AS raw_event_name, epoch_us({ISO}) AS at,
 CASE WHEN service = 'iam' THEN CASE name WHEN 'CreateUser' THEN 'iam.create_user' WHEN 'AttachRolePolicy' THEN 'iam.attach_policy'
    WHEN 'PutRolePolicy' THEN 'iam.attach_policy' ELSE 'iam.config_change' END
  WHEN service = 'sts' THEN CASE name WHEN 'AssumeRole' THEN 'iam.assume_role' ELSE 'auth.session_start' END
  WHEN service = 'signin' THEN 'auth.login' WHEN name LIKE 'Create%' THEN 'resource.create' WHEN name LIKE 'Delete%' THEN 'resource.delete'
  WHEN name LIKE 'Put%' OR name LIKE 'Update%' THEN 'resource.modify'
  WHEN name LIKE 'Get%' OR name LIKE 'Describe%' OR name LIKE 'List%' THEN 'access.read' ELSE 'unknown' END AS event_type,
 CASE kind WHEN 'Root' THEN 'root' WHEN 'IAMUser' THEN coalesce(uname, 'P' || user_id) WHEN 'FederatedUser' THEN coalesce(uname, 'P' || user_id)
  WHEN 'AssumedRole' THEN role WHEN 'AWSService' THEN CASE WHEN n % 2 = 0 THEN 'lambda.amazonaws.com' ELSE 'aws-service' END
  ELSE 'P' || user_id END AS actor_id,
 CASE kind WHEN 'AssumedRole' THEN CASE WHEN n % 5 = 0 THEN 'ai_agent' ELSE 'service_account' END WHEN 'AWSService' THEN 'service_account' ELSE 'human' END AS actor_type,
 CASE WHEN {no_target} THEN '' ELSE pv END AS target_id,
 CASE WHEN {no_target} THEN '' ELSE CASE param WHEN 'roleName' THEN 'iam_role' WHEN 'userName' THEN 'iam_user'
   WHEN 'groupName' THEN 'iam_group' WHEN 'policyArn' THEN 'iam_policy' WHEN 'bucketName' THEN 's3_bucket'
   WHEN 'functionName' THEN 'lambda_function' WHEN 'instanceId' THEN 'ec2_instance' ELSE 'iam_role' END END AS target_type,
 CASE WHEN {no_target} THEN '' WHEN param IN ('policyArn', 'roleArn') THEN 'T' || (n % 100) ELSE pv END AS target_name,
 event_type <> 'error' AS success,
 name IN ('CreateUser', 'AttachRolePolicy', 'AssumeRole', 'PutBucketPolicy', 'RunInstances', 'PutRolePolicy') AS is_privileged_action,
 name IN ('CreateUser', 'AttachRolePolicy', 'PutBucketPolicy', 'PutRolePolicy') AS is_config_change"""


def service_view(events):
    return events.select(
        "source_event_id", "raw_event_name", F.unix_micros("timestamp").alias("at"), "event_type", "actor_id",
        "actor_type", "target_id", "target_type", "target_name", "success", "is_privileged_action",
        "is_config_change",
    )


@case("cloudtrail_service_events", f"""
SELECT {service_columns("n % 11 = 0 OR param = 'policyName'")}
FROM trail WHERE (n % 4 <> 0 OR service IN ('iam', 'sts')) AND n % 50 <> 7""", TRAIL)
def _(b):
    return service_view(cloudtrail.normalise(cloudtrail.parse_records(payloads.trail_records(b)), "service"))


ARCHIVE_TYPE = """CASE WHEN service = 'iam' THEN CASE name WHEN 'CreateUser' THEN 'iam.create_user' WHEN 'AttachRolePolicy' THEN 'iam.attach_policy'
    WHEN 'PutRolePolicy' THEN 'iam.attach_policy' ELSE 'access.admin' END
  WHEN service = 'sts' THEN CASE name WHEN 'AssumeRole' THEN 'iam.assume_role' ELSE 'unknown' END
  WHEN service = 'signin' THEN 'auth.login' ELSE CASE name WHEN 'RunInstances' THEN 'resource.create' WHEN 'GetObject' THEN 'access.read'
   WHEN 'DeleteObject' THEN 'access.delete' WHEN 'ListBuckets' THEN 'access.list' WHEN 'DescribeInstances' THEN 'access.list'
   WHEN 'PutBucketPolicy' THEN 'access.admin' ELSE 'unknown' END END"""


@case("cloudtrail_archive_events", f"""
SELECT 'ev-' || n AS source_event_id, name AS raw_event_name, CASE WHEN n % 50 <> 7 THEN epoch_us({ISO}) END AS at, {ARCHIVE_TYPE} AS event_type,
 CASE WHEN n % 3 = 0 THEN 'arn:aws:iam::1:user/U' || user_id ELSE coalesce(uname, 'P' || user_id) END AS actor_id,
 CASE WHEN n % 10 = 3 THEN 'arn:res' WHEN n % 11 = 0 OR param IN ('policyName', 'roleArn') THEN '' ELSE pv END AS target_id,
 CASE service WHEN 'iam' THEN 'iam_resource' WHEN 'sts' THEN 'iam_session' WHEN 's3' THEN 's3_bucket' WHEN 'ec2' THEN 'ec2_instance'
  WHEN 'lambda' THEN 'lambda_function' WHEN 'kms' THEN 'kms_key' ELSE 'aws_resource' END AS target_type,
 CASE WHEN n % 11 = 0 OR param IN ('policyArn', 'instanceId', 'roleArn') THEN name ELSE pv END AS target_name,
 {ARCHIVE_TYPE} IN ('iam.attach_policy', 'iam.create_user') AS is_config_change
FROM trail""", TRAIL)
def _(b):
    records = cloudtrail.parse_records(payloads.trail_records(b))
    return cloudtrail.normalise(records, "archive").select(
        "source_event_id", "raw_event_name", F.unix_micros("timestamp").alias("at"), "event_type", "actor_id",
        "target_id", "target_type", "target_name", "is_config_change",
    )


@case("cloudtrail_undated_rejects", "SELECT 'ev-' || event_id AS source_event_id FROM events WHERE event_id % 50 = 7")
def _(b):
    records = cloudtrail.parse_records(payloads.trail_records(b))
    return cloudtrail.undated(cloudtrail.normalise(records, "archive")).select("source_event_id")


@case("cloudtrail_time_range", f"""
SELECT 'ev-' || event_id AS source_event_id FROM events
WHERE event_id % 50 <> 7 AND {ISO} BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""")
def _(b):
    records = cloudtrail.parse_records(payloads.trail_records(b))
    inside = cloudtrail.in_range(records, "eventTime", "2024-01-10 00:00:00", "2024-01-12 12:00:00")
    return inside.select(F.col("eventID").alias("source_event_id"))


@case("cloudtrail_lake_rows", f"""
SELECT {service_columns("n % 17 = 3 OR n % 11 = 0 OR param = 'policyName'")} FROM trail WHERE n % 50 <> 7""", TRAIL)
def _(b):
    # All records in the flat form; the parameters of some cannot be read, and none tells whether it only reads.
    records = cloudtrail.parse_records(payloads.trail_records(b))
    number = F.substr("eventID", F.lit(4)).cast("bigint")
    rows = records.select(
        "eventID", "eventTime", "eventName", "eventSource", F.to_json("userIdentity").alias("userIdentity"),
        F.when(number % 17 == 3, "{not json").otherwise(F.to_json("requestParameters")).alias("requestParameters"),
        "sourceIPAddress", "userAgent", F.coalesce("errorCode", F.lit("")).alias("errorCode"), "errorMessage",
    )
    return service_view(cloudtrail.normalise_service(cloudtrail.parse_lake_rows(rows)))


@case("cloudtrail_lookup_rows", f"""
SELECT 'ev-' || n AS source_event_id, service || ':' || name AS raw_event_name FROM trail
WHERE (n % 4 <> 0 OR service IN ('iam', 'sts')) AND n % 50 <> 7""", TRAIL)
def _(b):
    rows = payloads.trail_records(b).withColumnRenamed("value", "CloudTrailEvent")
    return cloudtrail.normalise_service(cloudtrail.parse_lookup_rows(rows)).select("source_event_id", "raw_event_name")


OKTA = {"syslog": f"""
SELECT *, event_id AS n, {listed(payloads.OKTA_NAMES)}[event_id % 11 + 1] AS name FROM events"""}


@case("okta_log_events", f"""
SELECT 'o-' || n AS source_event_id, name AS raw_event_name, epoch_us({ISO}) AS at,
 CASE name WHEN 'user.session.start' THEN 'auth.login' WHEN 'user.session.end' THEN 'auth.logout' WHEN 'user.authentication.auth_via_mfa' THEN 'auth.mfa_success'
  WHEN 'user.lifecycle.create' THEN 'iam.create_user' WHEN 'group.user_membership.add' THEN 'group.add_member' WHEN 'application.lifecycle.update' THEN 'resource.modify'
  WHEN 'policy.rule.update' THEN 'iam.config_change' WHEN 'user.account.privilege.grant' THEN 'iam.attach_policy' ELSE 'auth.password_change' END AS event_type,
 CASE WHEN n % 3 <> 0 THEN 'u' || user_id || '@corp.test' ELSE 'id' || user_id END AS actor_id,
 CASE WHEN n % 4 <> 0 THEN 'User ' || user_id WHEN n % 3 <> 0 THEN 'u' || user_id || '@corp.test' ELSE 'id' || user_id END AS actor_display_name,
 CASE WHEN n % 6 = 0 THEN 'service_account' ELSE 'human' END AS actor_type,
 CASE WHEN n % 5 <> 0 THEN 't' || (n % 40) ELSE '' END AS target_id, CASE WHEN n % 2 = 0 THEN 'Rome, Italy' ELSE 'Italy' END AS geo_location,
 event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE '' END AS error_code,
 name IN ('user.lifecycle.create', 'group.user_membership.add', 'user.account.privilege.grant', 'user.account.reset_password') AS is_privileged_action,
 name IN ('application.lifecycle.update', 'policy.rule.update') AS is_config_change
FROM syslog WHERE name NOT IN ('system.org.rate_limit.warning', 'something.else') AND n % 50 <> 7""", OKTA)
def _(b):
    raw = identity_logs.parse_json(payloads.okta_events(b), identity_logs.OKTA_EVENT)
    return identity_logs.normalise_okta(raw).select(
        "source_event_id", "raw_event_name", F.unix_micros("timestamp").alias("at"), "event_type", "actor_id",
        "actor_display_name", "actor_type", "target_id", "geo_location", "success", "error_code",
        "is_privileged_action", "is_config_change",
    )


@case("entra_audit_events", f"""
SELECT 'a-' || n AS source_event_id, name AS raw_event_name,
 CASE name WHEN 'Add user' THEN 'iam.create_user' WHEN 'Delete user' THEN 'iam.delete_user' WHEN 'Add member to role' THEN 'iam.attach_policy'
  WHEN 'Update policy' THEN 'iam.config_change' WHEN 'Add application' THEN 'resource.create' WHEN 'Consent to application' THEN 'app.user_assigned'
  WHEN 'Add service principal credentials' THEN 'iam.create_access_key' ELSE 'auth.password_change' END AS event_type,
 CASE WHEN n % 3 = 0 THEN 'app' || user_id WHEN n % 2 = 0 THEN 'u' || user_id || '@t' ELSE 'id' || user_id END AS actor_id,
 CASE WHEN n % 3 = 0 THEN 'service_account' ELSE 'human' END AS actor_type, 't' || (n % 40) AS target_id,
 event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'denied' ELSE '' END AS error_code,
 name IN ('Add user', 'Delete user', 'Add member to role', 'Consent to application', 'Add service principal credentials') AS is_privileged_action,
 name IN ('Update policy', 'Add service principal credentials') AS is_config_change
FROM (SELECT *, event_id AS n, {listed(payloads.ENTRA_NAMES)}[event_id % 9 + 1] AS name FROM events) WHERE name <> 'Unheard of'""")
def _(b):
    raw = identity_logs.parse_json(payloads.entra_audits(b), identity_logs.ENTRA_AUDIT)
    return identity_logs.normalise_entra_audit(raw).select(
        "source_event_id", "raw_event_name", "event_type", "actor_id", "actor_type", "target_id", "success",
        "error_code", "is_privileged_action", "is_config_change",
    )


@case("entra_sign_in_events", """
SELECT 's-' || event_id AS source_event_id, CASE WHEN event_id % 5 <> 0 THEN 'signIn:Mail' ELSE 'signIn:unknown' END AS raw_event_name,
 CASE WHEN event_id % 4 <> 0 THEN 'auth.login' WHEN event_type = 'error' THEN 'auth.mfa_failure' ELSE 'auth.mfa_success' END AS event_type,
 'u' || user_id || '@t' AS actor_id, CASE WHEN event_id % 2 = 0 THEN 'Oslo, NO' ELSE 'NO' END AS geo_location, 'Linux' AS user_agent,
 CASE WHEN event_id % 5 <> 0 THEN 'Mail' ELSE '' END AS target_name, CASE WHEN event_type = 'error' THEN '50126' ELSE '' END AS error_code FROM events""")
def _(b):
    raw = identity_logs.parse_json(payloads.entra_sign_ins(b), identity_logs.ENTRA_SIGN_IN)
    return identity_logs.normalise_entra_sign_in(raw).select(
        "source_event_id", "raw_event_name", "event_type", "actor_id", "geo_location", "user_agent", "target_name",
        "error_code",
    )


# --- cloud account ----------------------------------------------------------------------


def iam_users(b):
    return payloads.iam_users(b).select(F.from_json("value", cloud_iam.USER).alias("r")).select("r.*")


def iam_groups(b):
    return payloads.iam_groups(b).select(F.from_json("value", cloud_iam.GROUP).alias("r")).select("r.*")


def iam_roles(b):
    return payloads.iam_roles(b).select(F.from_json("value", cloud_iam.ROLE).alias("r")).select("r.*")


@case("iam_user_subjects", """
SELECT 'arn:aws:iam::1:user/u' || c_custkey AS external_id, 'u' || c_custkey AS display_name,
 CASE WHEN c_custkey % 4 IN (0, 1) THEN 'human' ELSE 'service_account' END AS type, c_custkey % 4 = 0 AS seen FROM customer""")
def _(b):
    return cloud_iam.user_subjects(iam_users(b)).select(
        "external_id", "display_name", "type", F.col("last_seen").isNotNull().alias("seen")
    )


@case("iam_inline_policies", """
SELECT 'inline' || (c_custkey % 3) AS name,
 CASE c_custkey % 3 WHEN 0 THEN 'iam:PassRole' WHEN 1 THEN 's3:GetObject,lambda:CreateFunction' ELSE 'ec2:*' END AS actions,
 'arn:aws:s3:::b' || (c_custkey % 50) AS resources, true AS is_privileged,
 CASE c_custkey % 3 WHEN 0 THEN 'passrole' WHEN 1 THEN 'create' ELSE '' END AS risk_keywords, count(*) AS holders
FROM customer GROUP BY ALL""")
def _(b):
    rows = cloud_iam.inline_policies(iam_users(b), "UserPolicyList")
    return rows.groupBy(
        "name", joined("actions"), joined("resources"), "is_privileged", joined("risk_keywords")
    ).agg(F.countDistinct("subject_id").alias("holders"))


@case("iam_managed_policies", """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'AdministratorAccess' WHEN 1 THEN 'ReadOnly' ELSE 'AmazonS3FullAccess' END AS name,
 c_custkey % 3 <> 1 AS is_privileged, count(*) AS holders FROM customer GROUP BY ALL""")
def _(b):
    return cloud_iam.managed_policies(iam_users(b)).groupBy("name", "is_privileged").agg(F.count("*").alias("holders"))


@case("iam_resources", """
SELECT DISTINCT 'arn:aws:s3:::b' || (c_custkey % 50) AS arn, 'b' || (c_custkey % 50) AS name, 's3_resource' AS type, 'high' AS sensitivity FROM customer""")
def _(b):
    rows = cloud_iam.inline_policies(iam_users(b), "UserPolicyList")
    return cloud_iam.resources_of(rows).select("arn", "name", "type", "sensitivity")


@case("arn_classification", """
SELECT 'arn:aws:' || x.svc || '::1:' || p_partkey AS arn, x.svc || '_resource' AS type,
 CASE WHEN x.svc IN ('kms', 'iam') THEN 'critical' WHEN x.svc IN ('s3', 'rds') THEN 'high' WHEN x.svc IN ('ec2', 'sqs') THEN 'medium' ELSE 'low' END AS sensitivity
FROM (SELECT p_partkey, ['kms', 's3', 'ec2', 'glue', 'iam', 'rds', 'sqs'][p_partkey % 7 + 1] AS svc FROM part) x""")
def _(b):
    service = payloads.pick(("kms", "s3", "ec2", "glue", "iam", "rds", "sqs"), F.col("p_partkey") % 7)
    arn = F.concat(F.lit("arn:aws:"), service, F.lit("::1:"), F.col("p_partkey").cast("string"))
    return b.table("part").select(arn.alias("arn")).select(
        "arn", cloud_iam.resource_type_of(F.col("arn")).alias("type"),
        cloud_iam.sensitivity_of(F.col("arn")).alias("sensitivity"),
    )


@case("action_privilege", """
SELECT id, a0 LIKE 'iam:%' OR a0 LIKE 'sts:%' OR a0 IN ('lambda:CreateFunction', 'ec2:RunInstances') AS is_privileged FROM permission""")
def _(b):
    return b.estate.permission.select("id", cloud_iam.is_privileged(F.col("actions")).alias("is_privileged"))


@case("iam_group_memberships", """
SELECT 'u' || c_custkey AS user_name, 'g' || (c_custkey % 12) AS group_name FROM customer
WHERE c_custkey % 12 < 10 AND c_custkey % 12 IN (SELECT s_suppkey % 10 FROM supplier)""")
def _(b):
    users, groups = iam_users(b), iam_groups(b)
    names = users.select(entity_id("aws_iam", F.col("Arn")).alias("subject_id"), F.col("UserName").alias("user_name"))
    held = groups.select(entity_id("aws_iam", F.col("Arn")).alias("permission_id"), F.col("GroupName").alias("group_name"))
    return (
        cloud_iam.group_memberships(users, groups)
        .join(names, "subject_id")
        .join(held, "permission_id")
        .select("user_name", "group_name")
    )


@case("iam_mfa_devices", """
SELECT 'u' || c_custkey AS display_name, c_custkey % 3 = 0 AS mfa_enabled FROM customer""")
def _(b):
    devices = payloads.customers(b).where(F.col("k") % 3 == 0).select(
        F.concat(F.lit("u"), F.col("k").cast("string")).alias("UserName"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("d")
    )
    subject = cloud_iam.user_subjects(iam_users(b))
    return cloud_iam.with_mfa_devices(subject, devices).select("display_name", "mfa_enabled")


@case("iam_trust_analysis", """
SELECT 'arn:aws:iam::1:role/r' || p_partkey AS external_id, CASE WHEN p_partkey % 3 = 1 THEN 'ai_agent' ELSE 'service_account' END AS type,
 CASE p_partkey % 5 WHEN 4 THEN NULL ELSE p_partkey % 5 IN (0, 1) END AS trust_policy_open,
 CASE p_partkey % 5 WHEN 4 THEN NULL ELSE p_partkey % 5 IN (2, 3) AND p_partkey % 3 <> 0 END AS cross_account_trust,
 CASE p_partkey % 5 WHEN 4 THEN NULL ELSE p_partkey % 5 = 2 AND p_partkey % 3 <> 0 END AS cross_account_no_conditions,
 CASE WHEN p_partkey % 5 IN (2, 3) AND p_partkey % 3 <> 0 THEN CAST(p_partkey % 3 + 1 AS VARCHAR) WHEN p_partkey % 5 = 4 THEN NULL ELSE '' END AS accounts FROM part""")
def _(b):
    return cloud_iam.role_subjects(iam_roles(b), "1").select(
        "external_id", "type", "trust_policy_open", "cross_account_trust", "cross_account_no_conditions",
        joined("cross_account_ids", "accounts"),
    )


@case("policy_directory", """
SELECT 'policy' || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'iam:CreateUser,s3:GetObject' WHEN 1 THEN 's3:*' ELSE 's3:GetObject' END AS actions,
 p_partkey % 4 <> 2 OR p_partkey % 3 = 1 AS is_privileged,
 concat_ws(',', CASE WHEN p_partkey % 4 = 0 THEN 'iam:CreateUser' END, CASE WHEN p_partkey % 3 = 1 THEN 'mamip:privesc' END,
   CASE WHEN p_partkey % 4 = 1 THEN 'wildcard:s3:*' END) AS risk_keywords FROM part WHERE p_partkey % 4 <> 3""")
def _(b):
    return cloud_iam.directory_permissions(payloads.policy_files(b)).select(
        "name", joined("actions"), "is_privileged", joined("risk_keywords")
    )


@case("iam_account_estate", """
SELECT (SELECT count(*) FROM customer) + (SELECT count(DISTINCT s_suppkey % 10) FROM supplier) + (SELECT count(*) FROM part) AS subjects,
 (SELECT count(*) FROM (SELECT DISTINCT c_custkey % 3, c_custkey % 2, c_custkey % 50 FROM customer)) + 3 AS permissions,
 (SELECT count(DISTINCT c_custkey % 50) FROM customer) AS resources""")
def _(b):
    details = {"users": iam_users(b), "groups": iam_groups(b), "roles": iam_roles(b)}
    estate = cloud_iam.account_estate(details, "1")
    one = lambda df, n: df.agg(F.count("*").alias(n)).withColumn("one", F.lit(1))
    # URL-encoded and plain copies of one document decode to the same text.
    return (
        one(estate.subject, "subjects").join(one(estate.permission, "permissions"), "one")
        .join(one(estate.resource, "resources"), "one").drop("one")
    )


# --- directories ---------------------------------------------------------------------------


@case("okta_subjects", """
SELECT 'u' || c_custkey AS external_id, CASE WHEN c_custkey % 5 <> 0 THEN 'Ann Lee' || c_custkey ELSE 'u' || c_custkey END AS display_name,
 CASE c_custkey % 7 WHEN 1 THEN 'inactive' WHEN 3 THEN 'suspended' WHEN 4 THEN 'deleted' WHEN 5 THEN 'suspended' ELSE 'active' END AS status,
 CASE WHEN c_custkey % 9 = 0 THEN 'service_account' ELSE 'human' END AS type,
 c_custkey % 4 = 0 AND c_custkey % 9 <> 0 AS mfa_enabled FROM customer""")
def _(b):
    return directories.okta_estate(payloads.okta_directory(b)).subject.select(
        "external_id", "display_name", "status", "type", "mfa_enabled"
    )


@case("okta_permissions", """
SELECT ['Admins', 'Owners', 'Staff'][p_partkey % 3 + 1] || ' ' || p_partkey AS name, p_partkey % 3 <> 2 AS is_privileged FROM part""")
def _(b):
    return directories.okta_groups(payloads.okta_directory(b)["groups"]).select("name", "is_privileged")


@case("okta_apps", """
SELECT ['AWS', 'Slack', 'Wiki', 'GitHub'][p_partkey % 4 + 1] || ' ' || p_partkey AS name,
 ['critical', 'high', 'medium', 'high'][p_partkey % 4 + 1] AS sensitivity FROM part""")
def _(b):
    return directories.okta_apps(payloads.okta_directory(b)["apps"]).select("name", "sensitivity")


@case("okta_admin_roles", """
SELECT CASE CAST(floor(c_custkey / 10) AS BIGINT) % 3 WHEN 0 THEN 'SUPER_ADMIN' WHEN 1 THEN 'APP_ADMIN' ELSE 'CUSTOM' END AS name,
 CAST(floor(c_custkey / 10) AS BIGINT) % 3 < 2 AS is_privileged, count(*) AS holders FROM customer WHERE c_custkey % 10 = 0 GROUP BY ALL""")
def _(b):
    rows = directories.okta_admin_roles(payloads.okta_directory(b)["roles"])
    return rows.groupBy("name", "is_privileged").agg(F.count("*").alias("holders"))


@case("okta_assignment_counts", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM line WHERE l_linenumber <= 2))
 + (SELECT count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM line WHERE l_linenumber = 3))
 + (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS assignments,
 (SELECT count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM line WHERE l_linenumber = 3)) AS scoped""")
def _(b):
    return directories.okta_estate(payloads.okta_directory(b)).assignment.agg(
        F.count("*").alias("assignments"), F.count("resource_id").alias("scoped")
    )


@case("entra_subjects", """
SELECT 'u' || c_custkey AS external_id, 'human' AS type, CASE WHEN c_custkey % 5 <> 0 THEN 'active' ELSE 'inactive' END AS status,
 CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey || '@t' ELSE 'u' || c_custkey || '@t' END AS email FROM customer
UNION ALL SELECT 'sp' || p_partkey, CASE WHEN p_partkey % 3 IN (0, 1) OR p_partkey % 7 = 0 THEN 'ai_agent' ELSE 'service_account' END, 'active', NULL FROM part
UNION ALL SELECT 'g' || s_suppkey, 'group', 'active', NULL FROM supplier""")
def _(b):
    return directories.entra_estate(payloads.entra_directory(b)).subject.select(
        "external_id", "type", "status", "email"
    )


@case("entra_permissions", """
SELECT ['Global Administrator', 'User Administrator', 'Directory Readers', 'Billing Administrator'][p_partkey % 4 + 1] AS name,
 p_partkey % 4 < 2 AS is_privileged, CASE WHEN p_partkey % 4 <> 2 THEN 'admin' ELSE '' END AS risk_keywords, count(*) AS n FROM part GROUP BY ALL
UNION ALL SELECT 'AppRole-Portal', false, '', count(DISTINCT (l_partkey % 5, l_suppkey)) FROM lineitem WHERE l_linenumber = 3""")
def _(b):
    return directories.entra_estate(payloads.entra_directory(b)).permission.groupBy(
        "name", "is_privileged", joined("risk_keywords")
    ).agg(F.count("*").alias("n"))


@case("entra_assignment_counts", """
SELECT (SELECT count(DISTINCT (l_partkey, o_custkey)) FROM line WHERE l_linenumber = 1)
 + (SELECT count(DISTINCT (l_suppkey, o_custkey)) FROM line WHERE l_linenumber = 2)
 + (SELECT count(DISTINCT (l_partkey % 5, l_suppkey, o_custkey)) FROM line WHERE l_linenumber = 3) AS assignments""")
def _(b):
    return directories.entra_estate(payloads.entra_directory(b)).assignment.agg(F.count("*").alias("assignments"))


# --- ERP ---------------------------------------------------------------------------------------


@case("erp_employees", """
SELECT CAST(c_custkey AS VARCHAR) AS external_id, CASE WHEN c_custkey % 4 <> 0 THEN 'Eve Fox' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS display_name,
 CASE WHEN c_custkey % 4 IN (1, 3) THEN 'inactive' ELSE 'active' END AS status, c_custkey > 0 AS has_manager FROM customer""")
def _(b):
    return erp.employees(payloads.erp_tables(b)["employee"]).select(
        "external_id", "display_name", "status", F.col("manager_id").isNotNull().alias("has_manager")
    )


ERP_RIGHT = {"erp_right": f"""
SELECT DISTINCT CAST(p_partkey % 500 AS VARCHAR) AS role, {listed(payloads.ERP_KEYS)}[p_partkey % 6 + 1] AS key,
  ['none', 'view', 'create', 'edit', 'full'][p_partkey % 5 + 1] AS lvl, p_partkey % 5 AS level FROM part"""}


@case("erp_roles", """
SELECT 'Role ' || role AS name, string_agg('netsuite:' || key || '.' || lvl, ',' ORDER BY 'netsuite:' || key || '.' || lvl) AS actions,
 bool_or((key NOT IN ('REPT_OTHER') AND level >= 2) OR key = 'ADMI_SETUP') AS is_privileged FROM erp_right GROUP BY 1""", ERP_RIGHT)
def _(b):
    source = payloads.erp_tables(b)
    return erp.roles(source["role"], source["rolepermissions"]).select("name", joined("actions"), "is_privileged")


@case("erp_role_grants", """
SELECT count(*) AS grants FROM (SELECT DISTINCT o_custkey, l_partkey % 600 AS r FROM line) WHERE r IN (SELECT p_partkey % 500 FROM part)""")
def _(b):
    source = payloads.erp_tables(b)
    return erp.role_grants(source["employeeroles"], source["role"]).agg(F.count("*").alias("grants"))


@case("erp_resources", """
SELECT s_name AS name, 'high' AS sensitivity FROM supplier
UNION ALL SELECT * FROM (VALUES ('Accounts Payable', 'critical'), ('Accounts Receivable', 'critical'), ('General Ledger', 'critical'),
 ('Payroll', 'critical'), ('Procurement', 'high'), ('System Setup', 'critical'), ('Financial Reporting', 'high'))""")
def _(b):
    return erp.erp_estate(payloads.erp_tables(b)).resource.select("name", "sensitivity")


AUDIT = {"emp_role": f"""
SELECT 'Emp ' || o_custkey AS name, {listed(payloads.ERP_ROLE_NAMES)}[l_partkey % 11 + 1] AS role,
  min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS pos FROM line GROUP BY 1, 2"""}


@case("erp_audit_departments", """
SELECT name, coalesce(arg_min(dept, pos), 'Finance') AS department FROM (SELECT name, pos, CASE
 WHEN role LIKE '%Controller%' THEN 'Accounting' WHEN role LIKE '%Revenue%' THEN 'Revenue Accounting' WHEN lower(role) LIKE '%ap%' THEN 'Accounts Payable'
 WHEN role LIKE '%Credit%' THEN 'Credit & Collections' WHEN role LIKE '%Shared Services%' THEN 'Shared Services'
 WHEN role LIKE '%Fixed Assets%' THEN 'Fixed Assets' WHEN role LIKE '%Human Resources%' THEN 'Human Resources' WHEN role LIKE '%Buyer%' THEN 'Procurement'
 WHEN role LIKE '%EFT%' THEN 'Treasury' WHEN role LIKE '%Messenger%' THEN 'IT' END AS dept FROM emp_role) WHERE dept IS NOT NULL GROUP BY 1
UNION ALL SELECT name, 'Finance' FROM emp_role GROUP BY 1 HAVING bool_and(role = 'Warehouse')""", AUDIT)
def _(b):
    return erp.infer_departments(payloads.audit_document(b)["employee_role"])


@case("erp_audit_findings", """
SELECT 'Emp ' || c_custkey AS name, ['Make Journal Entry', 'Vendors', 'Credit Memo', 'Customers', 'Customers', 'Invoice'][c_custkey % 7 + 1] AS first_action,
 [0.97, 0.98, 0.93, 0.92, 0.91, 0.85][c_custkey % 7 + 1]::DOUBLE AS confidence FROM customer
WHERE c_custkey % 7 < 6 AND c_custkey % 3 <> 0 AND c_custkey IN (SELECT o_custkey FROM line)""")
def _(b):
    source = payloads.audit_document(b)
    return erp.audit_findings(source["violator"], source["employee"]).select(
        F.split_part("id", F.lit("/"), F.lit(2)).alias("name"), F.col("steps")[0]["action"].alias("first_action"),
        "confidence",
    )


@case("erp_role_bundles", f"""
SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'Make Journal Entry' WHEN 1 THEN 'Invoice' WHEN 2 THEN 'Vendors' WHEN 3 THEN 'Vendors'
 WHEN 4 THEN 'Make Journal Entry' WHEN 5 THEN 'Employee Record' WHEN 6 THEN 'Purchase Order' WHEN 7 THEN 'Pay Bills' WHEN 9 THEN 'Credit Memo' ELSE 'View' END AS first_action,
 p_partkey % 11 = 0 AS is_privileged FROM part""")
def _(b):
    bundle = erp.role_bundle(payloads.pick(payloads.ERP_ROLE_NAMES, F.col("p_partkey") % 11))
    return b.table("part").select("p_partkey", bundle.alias("bundle")).select(
        "p_partkey", F.col("bundle.actions")[0].alias("first_action"), "bundle.is_privileged"
    )


# --- health and trading tenants --------------------------------------------------------------------


@case("health_subjects", """
SELECT 'E-' || c_custkey AS external_id, ['human', 'ai_agent', 'service_account', 'human'][c_custkey % 4 + 1] AS type,
 CASE WHEN c_custkey % 6 = 0 THEN 'inactive' ELSE 'active' END AS status,
 CASE WHEN c_custkey % 4 = 1 THEN NULL WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END AS mfa_enabled, c_custkey % 200 AS idle FROM customer""")
def _(b):
    from gatewarden.functions.scalars import as_of_lit, whole_days

    rows = tenants.health_subjects(payloads.health_tables(b)["entities"], bind.AS_OF)
    return rows.select(
        "external_id", "type", "status", "mfa_enabled",
        whole_days(as_of_lit(bind.AS_OF), F.col("last_seen")).alias("idle"),
    )


HEALTH_GRANT = {"health_grant": f"""
SELECT 'E-' || k AS entity, unnest(CASE WHEN k % 3 = 0 AND role IN ('Attending Physician', 'IT System Admin') THEN [role, 'Break-Glass Emergency'] ELSE [role] END) AS role
FROM (SELECT c_custkey AS k, {listed(payloads.HEALTH_ROLE_NAMES)}[c_custkey % 8 + 1] AS role FROM customer)"""}


@case("health_assignments", """
SELECT role, count(DISTINCT entity) AS holders FROM health_grant WHERE role <> 'Unlisted' GROUP BY 1""", HEALTH_GRANT)
def _(b):
    source = payloads.health_tables(b)
    names = source["roles"].select("role", entity_id("healthcare", F.concat(F.lit("role:"), F.col("role"))).alias("permission_id"))
    return (
        tenants.health_assignments(source["entities"], source["roles"])
        .join(F.broadcast(names), "permission_id")
        .groupBy("role")
        .agg(F.countDistinct("subject_id").alias("holders"))
    )


@case("health_resources", """
SELECT s_name AS name, 'high' AS sensitivity FROM supplier
UNION ALL SELECT d || ' — ' || s_name, CASE WHEN d = 'Psychiatry' THEN 'critical' WHEN d IN ('ICU', 'Oncology', 'Emergency') THEN 'high' ELSE 'medium' END
 FROM (SELECT s_name, unnest([['Psychiatry', 'ICU', 'Cardiology', 'Oncology', 'Radiology'][s_suppkey % 5 + 1], 'Emergency']) AS d FROM supplier)
UNION ALL SELECT * FROM (VALUES ('EHR Clinical Notes', 'critical'), ('FHIR Server', 'critical'), ('Pharmacy Dispensing', 'high'), ('Billing System', 'high'),
 ('Lab Results', 'high'), ('Radiology PACS', 'high'), ('Patient Portal', 'medium'), ('Research Data Warehouse', 'high'), ('Audit Log System', 'critical'))""")
def _(b):
    return tenants.health_resources(payloads.health_tables(b)["facilities"]).select("name", "sensitivity")


@case("health_role_keywords", """
SELECT c_custkey, ['', '', 'phi_billing', 'admin_access', 'ai_agent', 'controlled_substance', 'break_glass', ''][c_custkey % 8 + 1] AS keywords FROM customer""")
def _(b):
    role = payloads.pick(payloads.HEALTH_ROLE_NAMES, F.col("k") % 8)
    return payloads.customers(b).select("c_custkey", joined_keywords(tenants.health_role_keywords(role)))


def joined_keywords(column):
    return F.array_join(column, ",").alias("keywords")


@case("health_findings", """
SELECT 'V-' || c_custkey AS id, ['Access PHI Outside Role Scope', 'Excessive Record Access', 'Break-Glass Emergency Override', 'Dormant Credential Active',
 'AI Agent Cross-Department Access', 'Cross-System PHI Access', 'PHI Access Without MFA', 'Excessive Bulk Data Export', 'VIP Record Access'][c_custkey % 10 + 1] AS first_action,
 CASE c_custkey % 10 WHEN 0 THEN 'Accessed ' || CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'restricted records' END
  WHEN 1 THEN 'Accessed ' || (c_custkey % 90) || ' records in 30 days (peer median: N/A)' WHEN 2 THEN 'Used N/A times in 30 days (peer avg: N/A)'
  WHEN 3 THEN 'Contract ended unknown — N/A days ago' WHEN 4 THEN 'Accessed departments: A, B. Expected: N/A' WHEN 5 THEN 'Systems accessed: '
  WHEN 6 THEN 'Role: N/A — PHI access level: N/A' WHEN 7 THEN 'Performed 0 exports in 30 days (peer avg: 0)'
  ELSE 'Accessed VIP record — care team member: ' || CASE WHEN c_custkey % 3 = 0 THEN 'True' ELSE 'False' END END AS first_text,
 [2, 2, 2, 2, 3, 2, 1, 2, 2][c_custkey % 10 + 1] AS steps FROM customer WHERE c_custkey % 10 < 9 AND c_custkey % 8 <> 7""")
def _(b):
    source = payloads.health_tables(b)
    return tenants.health_findings(source["violations"], source["entities"]).select(
        "id", F.col("steps")[0]["action"].alias("first_action"), F.col("steps")[0]["description"].alias("first_text"),
        F.size("steps").alias("steps"),
    )


@case("health_violation_rules", """
SELECT violation_class, count(*) AS n FROM (SELECT [15, 6, 14, 4, 10, 9, 8, 11, 15][c_custkey % 10 + 1] AS violation_class FROM customer WHERE c_custkey % 10 < 9) GROUP BY 1""")
def _(b):
    rows = tenants.violation_rules(payloads.health_tables(b)["violations"], tenants.HEALTH_RULES)
    return rows.groupBy("violation_class").agg(F.count("*").alias("n"))


@case("trading_subjects", """
SELECT 'E-' || c_custkey AS external_id, ['Equities Trading', 'Fixed Income Trading', 'Equity Research', 'Compliance', 'Trading'][c_custkey % 5 + 1] AS department FROM customer""")
def _(b):
    return tenants.trading_subjects(payloads.trading_tables(b)["entities"], bind.AS_OF).select("external_id", "department")


@case("trading_resources", """
SELECT s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'critical' WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'medium' END AS sensitivity FROM supplier
UNION ALL SELECT n_name, 'critical' FROM nation
UNION ALL SELECT * FROM (VALUES ('Order Management System', 'critical'), ('Block Order Book', 'critical'), ('Market Data Feed', 'medium'), ('Research Portal', 'high'),
 ('Trade Blotter', 'critical'), ('Communications Surveillance', 'critical'), ('Restricted List', 'critical'), ('P&L / Risk System', 'high'), ('Settlement System', 'high'),
 ('Audit Trail', 'critical'), ('Client Flow Data', 'critical'))""")
def _(b):
    source = payloads.trading_tables(b)
    return tenants.trading_resources(source["desks"], source["barriers"]).select("name", "sensitivity")


@case("trading_role_holders", """
SELECT name, holders, keywords FROM (SELECT c_custkey % 7 AS i, count(*) AS holders FROM customer GROUP BY 1) x JOIN (VALUES
 (0, 'Trader — Equities', 'order_execution'), (1, 'Trader — Fixed Income', 'order_execution'),
 (2, 'Compliance Officer', 'order_execution,privileged_access,compliance_access'),
 (3, 'Research Analyst', 'order_execution,chinese_wall_restricted,research_silo'),
 (4, 'Block Trader', 'order_execution,mnpi_access,block_trading'), (5, 'Settlement Operations', 'order_execution,operations'),
 (6, 'AI Pre-Trade Analytics', 'order_execution,ai_agent')) r(i, name, keywords) ON r.i = x.i""")
def _(b):
    source = payloads.trading_tables(b)
    permission = tenants.trading_permissions(source["roles"]).select(
        F.col("id").alias("permission_id"), "name", joined("risk_keywords", "keywords")
    )
    held = tenants.trading_assignments(source["entities"], source["roles"])
    return held.join(F.broadcast(permission), "permission_id").groupBy("name", "keywords").agg(
        F.countDistinct("subject_id").alias("holders")
    )


@case("trading_findings", """
SELECT 'V-' || c_custkey AS id, CASE c_custkey % 11 WHEN 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'Desk X' ELSE 'Research System' END
  WHEN 1 THEN 'Block Order Book' WHEN 2 THEN CASE WHEN c_custkey % 4 = 0 THEN 'Desk X' ELSE 'Block Order Book' END WHEN 3 THEN 'Restricted List / Personal Trading'
  WHEN 4 THEN 'Multiple Trading Desks' WHEN 5 THEN 'Trading Systems' WHEN 6 THEN 'Block Order Book / Client Flow' WHEN 7 THEN 'Trading Desk Positions / P&L'
  WHEN 8 THEN 'Settlement System' ELSE 'Trading Systems' END AS first_resource,
 [2, 3, 2, 2, 2, 2, 3, 2, 2, 1][c_custkey % 11 + 1] AS steps FROM customer WHERE c_custkey % 11 < 10 AND c_custkey % 8 <> 7""")
def _(b):
    source = payloads.trading_tables(b)
    return tenants.trading_findings(source["violations"], source["entities"]).select(
        "id", F.col("steps")[0]["resource"].alias("first_resource"), F.size("steps").alias("steps")
    )


# --- posture and measured findings ------------------------------------------------------------------------

POSTURE = """
SELECT 'weak-mfa' AS kind, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 IN (0, 2)
UNION ALL SELECT 'dormant', count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 200 + 1 > 90
UNION ALL SELECT 'stale-token', count(*) FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 4 = 0 AND c_custkey % 300 > 90
UNION ALL SELECT 'superadmins', count(*) FROM (SELECT c_nationkey % 5 FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1 HAVING count(*) > 5)
UNION ALL SELECT 'threat-insight', 2"""


@case("posture_findings", POSTURE)
def _(b):
    rows = posture.posture_findings(payloads.admins(b), payloads.tenants(b), bind.AS_OF)
    return rows.select(F.split_part("id", F.lit("/"), F.lit(1)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@case("posture_estate", """
SELECT (SELECT count(*) FROM customer) + 5 AS subjects, (SELECT count(*) FROM customer) AS assignments,
 (SELECT count(*) FROM customer WHERE c_custkey % 5 = 4) AS without_mfa""")
def _(b):
    estate = posture.posture_estate(payloads.admins(b), payloads.tenants(b), bind.AS_OF)
    subjects = estate.subject.agg(
        F.count("*").alias("subjects"), F.count_if(F.col("mfa_enabled") == F.lit(False)).alias("without_mfa")
    ).withColumn("one", F.lit(1))
    grants = estate.assignment.agg(F.count("*").alias("assignments")).withColumn("one", F.lit(1))
    return subjects.join(grants, "one").drop("one")


@case("finding_peer_volumes", f"""
SELECT s.id AS actor_id, v.n, m.med AS peer_median, round(coalesce(v.n / nullif(m.med, 0)::DOUBLE, 0), 6) AS ratio_to_peer FROM volume v
JOIN subject s ON s.id = v.id JOIN (SELECT g, max(CASE WHEN rn = CAST(floor(size / 2) AS BIGINT) + 1 THEN n END) AS med FROM
 (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY n) AS rn, count(*) OVER (PARTITION BY g) AS size FROM volume) GROUP BY 1) m ON m.g = v.g""",
      {"volume": """
SELECT s.id, lower(trim(coalesce(s.department, 'unknown'))) AS g, coalesce(e.n, 0) AS n FROM subject s
LEFT JOIN (SELECT actor_id, count(*) AS n FROM recent WHERE event_type = 'access.read' GROUP BY 1) e ON e.actor_id = s.id WHERE s.type <> 'group'"""})
def _(b):
    members = b.estate.subject.where(F.col("type") != "group").select(
        F.col("id").alias("actor_id"), peer_department(F.col("department")).alias("peer_group")
    )
    rows = findings.peer_volumes(b.estate.event, members, bind.EVENT_AS_OF, F.col("event_type") == "access.read")
    return rows.select("actor_id", "n", "peer_median", r6("ratio_to_peer"))


@case("finding_ended_with_access", f"""
SELECT s.id AS subject_id, {days(AS_OF, 's.last_seen')} AS days_since_end, a.n AS active_permissions FROM subject s
JOIN (SELECT subject_id, count(*) AS n FROM assignment WHERE is_active GROUP BY 1) a ON a.subject_id = s.id
WHERE s.status = 'deleted' AND {days(AS_OF, 's.last_seen')} > 0""")
def _(b):
    ends = b.estate.subject.where(F.col("status") == "deleted").select(
        F.col("id").alias("subject_id"), F.col("last_seen").alias("ended_at")
    )
    return findings.ended_with_access(b.estate, ends, bind.AS_OF)


@case("finding_outside_scope", """
SELECT DISTINCT actor_id, event_type AS place FROM event WHERE NOT (CAST(substr(actor_id, 2) AS BIGINT) % 2 = 0 AND event_type = 'access.read')""")
def _(b):
    events = b.estate.event.withColumn("target_type", F.col("event_type"))
    even = F.substr("id", F.lit(2)).cast("bigint") % 2 == 0
    scopes = b.estate.subject.where(even).select(F.col("id").alias("actor_id"), F.lit("access.read").alias("place"))
    return findings.outside_scope(events, scopes)


@case("finding_barrier_crossings", f"""
SELECT DISTINCT 'S' || c_custkey AS subject_id, b.id AS barrier_id, home, desk FROM (SELECT c_custkey, {listed(payloads.DESKS)}[c_custkey % 5 + 1] AS home,
  {listed(payloads.DESKS)}[c_custkey % 4 + 1] AS desk FROM customer) c
JOIN (SELECT 'IB-' || n_nationkey AS id, {listed(payloads.DESKS)}[n_nationkey % 5 + 1] AS a, {listed(payloads.DESKS)}[(n_nationkey + 1) % 5 + 1] AS b1,
  {listed(payloads.DESKS)}[(n_nationkey + 2) % 5 + 1] AS b2 FROM nation) b
ON (home = a AND desk IN (b1, b2)) OR (home IN (b1, b2) AND desk = a)""")
def _(b):
    desks = payloads.customers(b).select(
        F.concat(F.lit("S"), F.col("k").cast("string")).alias("subject_id"),
        payloads.pick(payloads.DESKS, F.col("k") % 5).alias("home_desk"),
        payloads.pick(payloads.DESKS, F.col("k") % 4).alias("desk"),
    )
    rows = findings.barrier_crossings(desks, payloads.trading_tables(b)["barriers"])
    return rows.select("subject_id", "barrier_id", F.col("home_desk").alias("home"), "desk")


@case("finding_toxic_actions", """
SELECT subject_id FROM sa WHERE action IN ('svc1:Op1', 'svc2:Op2', 'iam:PassRole') GROUP BY 1 HAVING count(*) = 3""")
def _(b):
    return findings.holds_all(b.estate, ("svc1:Op1", "svc2:Op2", "iam:PassRole"))


# --- stored tables ----------------------------------------------------------------------------------------------


def _scratch(b, name):
    import uuid

    return f"{durable_root(b.spark)}/gatewarden/{name}-{uuid.uuid4().hex}"


@case("feature_history", """
SELECT count(*) AS kept, count(DISTINCT m) AS snapshots FROM (SELECT unnest(range(2, 5)) AS m) x JOIN subject ON true""")
def _(b):
    rows = b.estate.subject.select(F.col("id").alias("subject_id"), "status")
    path = _scratch(b, "history")
    for month in range(1, 5):
        tables.append_feature_snapshot(rows, path, f"2001-0{month}-01 00:00:00")
    kept = tables.retained(b.spark.read.parquet(path), previous=2)
    return kept.agg(F.count("*").alias("kept"), F.countDistinct("computed_at").alias("snapshots"))


@case("feature_lookback", "SELECT count(*) * 2 AS kept FROM subject")
def _(b):
    rows = b.estate.subject.select(F.col("id").alias("subject_id"), "status")
    path = _scratch(b, "history")
    for month in range(1, 5):
        tables.append_feature_snapshot(rows, path, f"2001-0{month}-01 00:00:00")
    return tables.lookback(b.spark.read.parquet(path), "2001-04-15 00:00:00", 50).agg(F.count("*").alias("kept"))


@case("label_files", """
SELECT 'bootstrap' AS source, 'S' || c_custkey AS subject_id, c AS violation_class, (c_custkey + c) % 2 AS label, 0.5::DOUBLE AS confidence
FROM customer, (SELECT unnest([1, 2, 3]) AS c)""")
def _(b):
    return tables.labels_from_json(label_json(b), "bootstrap").select(
        "source", "subject_id", "violation_class", "label", "confidence"
    )


def label_json(b):
    """One JSON line per customer, three classes each."""
    k = F.col("k")
    entry = lambda c: F.struct(
        F.lit(c).alias("violation_class"), ((k + c) % 2).alias("label"), F.lit(0.5).alias("confidence")
    )
    return payloads.customers(b).select(
        F.to_json(
            F.create_map(F.concat(F.lit("S"), k.cast("string")), F.array(*[entry(c) for c in (1, 2, 3)]))
        ).alias("value")
    )


# --- readers over landed files -----------------------------------------------------------


def by_day(b, rows, name, time_column):
    """Log lines as files, one folder per day of the events."""
    path = _scratch(b, name)
    day = F.coalesce(F.substr(F.get_json_object("value", f"$.{time_column}"), F.lit(1), F.lit(10)), F.lit("none"))
    rows.withColumn("day", day).repartition("day").write.partitionBy("day").text(path)
    return path


FROM, TO = "2024-01-10 06:00:00", "2024-01-12 12:00:00"


def feed_range(b, feed, rows):
    path = by_day(b, rows, f"log-{feed}", identity_logs.FEEDS[feed][1])
    return identity_logs.read_range(b.spark, identity_logs.manifest_of(b.spark, path, feed), feed, FROM, TO)


def range_sql(prefix, dated="true"):
    return f"""
SELECT '{prefix}-' || event_id AS event, epoch_us({ISO}) AS at FROM events
WHERE {dated} AND {ISO} BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"""


def event_times(events, name, time_column):
    return events.select(F.col(name).alias("event"), F.unix_micros(iso_timestamp(F.col(time_column))).alias("at"))


@case("okta_log_range", range_sql("o", "event_id % 50 <> 7"))
def _(b):
    return event_times(feed_range(b, "okta", payloads.okta_events(b)), "uuid", "published")


@case("entra_audit_log_range", range_sql("a"))
def _(b):
    return event_times(feed_range(b, "entra_audit", payloads.entra_audits(b)), "id", "activityDateTime")


@case("entra_sign_in_log_range", range_sql("s"))
def _(b):
    return event_times(feed_range(b, "entra_sign_in", payloads.entra_sign_ins(b)), "id", "createdDateTime")


@case("log_manifest", f"""
SELECT strftime({ISO}, '%Y-%m-%d') AS day, epoch_us(min({ISO})) AS first_at, epoch_us(max({ISO})) AS last_at, count(*) AS events FROM events GROUP BY 1""")
def _(b):
    path = by_day(b, payloads.entra_sign_ins(b), "log-manifest", "createdDateTime")
    files = identity_logs.manifest_of(b.spark, path, "entra_sign_in")
    return files.groupBy(F.regexp_extract("file", "day=([0-9-]+)", 1).alias("day")).agg(
        F.unix_micros(F.min("first_at")).alias("first_at"), F.unix_micros(F.max("last_at")).alias("last_at"), F.sum("events").alias("events")
    )


def documents_of(b, rows, name, key, opening, closing):
    """JSON documents of many entries each: one per value of ``key``."""
    path = _scratch(b, name)
    text = F.concat(F.lit(opening), F.listagg("value", F.lit(",")), F.lit(closing))
    rows.groupBy(key.alias("part")).agg(text.alias("value")).select("value", "part").write.partitionBy("part").text(path)
    return path


#: Records in a file of the archive, about.
ARCHIVE_RECORDS = 20_000


@case("cloudtrail_archive_read", """
SELECT 'ev-' || event_id AS source_event_id, event_type <> 'error' AS success FROM events""")
def _(b):
    records = cloudtrail.parse_records(payloads.trail_records(b))
    path = _scratch(b, "archive")
    # A file is read whole, so their number follows the events, as a trail's does.
    files = 7 + b.table("events").count() // ARCHIVE_RECORDS
    documents = records.groupBy((F.crc32("eventID") % files).alias("part")).agg(F.collect_list(F.struct(*records.columns)).alias("Records"))
    documents.write.partitionBy("part").json(path, compression="gzip")
    return cloudtrail.normalise(cloudtrail.read_archive(b.spark, path), "archive").select("source_event_id", "success")


@case("label_documents", """
SELECT 'human' AS source, 'S' || c_custkey AS subject_id, c AS violation_class, (c_custkey + c) % 2 AS label, c - 1 AS pos
FROM customer, (SELECT unnest([1, 2, 3]) AS c)""")
def _(b):
    k = F.col("c_custkey")
    entries = F.transform(
        F.sequence(F.lit(1), F.lit(3)),
        lambda c: F.struct(c.alias("violation_class"), ((k + c) % 2).cast("int").alias("label"), F.lit(0.5).alias("confidence")),
    )
    rows = b.table("customer").select(
        "c_custkey", F.concat(F.lit('"S'), k.cast("string"), F.lit('": '), F.to_json(entries)).alias("value")
    )
    path = documents_of(b, rows, "label-documents", k % 5, "{", "}")
    return tables.read_labels(b.spark, path, "human").select("source", "subject_id", "violation_class", "label", "pos")
