"""Vendor payloads derived from the test tables, as JSON text one row per record.

Each builder has an SQL twin in the case modules that computes the normalised
result directly, so the readers are checked on every row of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewarden import bind

TRAIL_NAMES = (
    "CreateUser", "AttachRolePolicy", "AssumeRole", "GetObject", "PutBucketPolicy", "RunInstances",
    "ConsoleLogin", "DescribeInstances", "DeleteObject", "UpdateThing", "ListBuckets", "FooBar",
    "PutRolePolicy",
)
TRAIL_SERVICES = ("iam", "sts", "signin", "s3", "ec2", "lambda", "kms")
TRAIL_KINDS = ("Root", "IAMUser", "AssumedRole", "AWSService", "FederatedUser", "SAMLUser")
TRAIL_PARAMS = (
    "roleName", "userName", "groupName", "policyArn", "bucketName", "functionName", "instanceId", "roleArn",
    "policyName",
)
OKTA_NAMES = (
    "user.session.start", "user.session.end", "user.authentication.auth_via_mfa", "user.lifecycle.create",
    "group.user_membership.add", "application.lifecycle.update", "policy.rule.update",
    "system.org.rate_limit.warning", "something.else", "user.account.privilege.grant",
    "user.account.reset_password",
)
ENTRA_NAMES = (
    "Add user", "Delete user", "Add member to role", "Update policy", "Add application", "Unheard of",
    "Consent to application", "Add service principal credentials", "Reset user password",
)


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def text(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def events(b) -> DataFrame:
    return b.table("events").withColumn("n", F.col("event_id"))


def trail_records(b) -> DataFrame:
    """Cloud audit records, one JSON text per event."""
    n, user = F.col("n"), text("user_id")
    kind = pick(TRAIL_KINDS, n % 6)
    name = pick(TRAIL_PARAMS, n % 9)
    param = F.concat(F.lit("arn:x/T"), text(n % 100))
    identity = F.struct(
        kind.alias("type"),
        F.when(n % 3 == 0, F.concat(F.lit("arn:aws:iam::1:user/U"), user)).alias("arn"),
        F.concat(F.lit("P"), user).alias("principalId"),
        F.when(n % 4 != 1, F.concat(F.lit("U"), user)).alias("userName"),
        F.lit("AK").alias("accessKeyId"),
        F.when(n % 2 == 0, F.lit("lambda.amazonaws.com")).alias("invokedBy"),
        F.struct(
            F.struct(
                F.when(n % 5 == 0, F.concat(F.lit("Agent-"), user))
                .otherwise(F.concat(F.lit("deploy"), user)).alias("userName")
            ).alias("sessionIssuer")
        ).alias("sessionContext"),
    )
    record = F.struct(
        F.concat(F.lit("ev-"), text(n)).alias("eventID"),
        F.when(n % 50 == 7, F.lit("not a time")).otherwise(iso_seconds(F.col("ts"))).alias("eventTime"),
        pick(TRAIL_NAMES, n % 13).alias("eventName"),
        F.concat(pick(TRAIL_SERVICES, n % 7), F.lit(".amazonaws.com")).alias("eventSource"),
        F.lit("eu-west-1").alias("awsRegion"),
        (n % 4 == 0).alias("readOnly"),
        identity.alias("userIdentity"),
        F.when(n % 11 != 0, F.create_map(name, param)).alias("requestParameters"),
        F.when(n % 10 == 3, F.array(F.struct(F.lit("arn:res").alias("ARN")))).alias("resources"),
        F.concat(F.lit("10.0.0."), F.get_json_object("props", "$.k")).alias("sourceIPAddress"),
        F.lit("cli").alias("userAgent"),
        F.when(F.col("event_type") == "error", F.lit("AccessDenied")).alias("errorCode"),
    )
    return events(b).select(F.to_json(record).alias("value"))


def okta_events(b) -> DataFrame:
    """Identity-provider system-log events, one JSON text per event."""
    n, user = F.col("n"), text("user_id")
    record = F.struct(
        F.concat(F.lit("o-"), text(n)).alias("uuid"),
        pick(OKTA_NAMES, n % 11).alias("eventType"),
        F.when(n % 50 == 7, F.lit("")).otherwise(iso_seconds(F.col("ts"))).alias("published"),
        F.struct(
            F.concat(F.lit("id"), user).alias("id"),
            F.when(n % 3 != 0, F.concat(F.lit("u"), user, F.lit("@corp.test"))).alias("alternateId"),
            F.when(n % 4 != 0, F.concat(F.lit("User "), user)).alias("displayName"),
            F.when(n % 6 == 0, F.lit("PublicClientApp")).otherwise("User").alias("type"),
        ).alias("actor"),
        F.when(
            n % 5 != 0,
            F.array(F.struct(F.concat(F.lit("t"), text(n % 40)).alias("id"), F.lit("AppInstance").alias("type"))),
        ).alias("target"),
        F.struct(
            F.concat(F.lit("10.0.0."), F.get_json_object("props", "$.k")).alias("ipAddress"),
            F.struct(
                F.when(n % 2 == 0, F.lit("Rome")).alias("city"), F.lit("Italy").alias("country")
            ).alias("geographicalContext"),
        ).alias("client"),
        F.struct(
            F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("result")
        ).alias("outcome"),
    )
    return events(b).select(F.to_json(record).alias("value"))


def entra_audits(b) -> DataFrame:
    n, user = F.col("n"), text("user_id")
    record = F.struct(
        F.concat(F.lit("a-"), text(n)).alias("id"),
        pick(ENTRA_NAMES, n % 9).alias("activityDisplayName"),
        iso_seconds(F.col("ts")).alias("activityDateTime"),
        F.struct(
            F.when(
                n % 3 != 0,
                F.struct(
                    F.concat(F.lit("id"), user).alias("id"),
                    F.when(n % 2 == 0, F.concat(F.lit("u"), user, F.lit("@t"))).alias("userPrincipalName"),
                ),
            ).alias("user"),
            F.when(n % 3 == 0, F.struct(F.concat(F.lit("app"), user).alias("appId"))).alias("app"),
        ).alias("initiatedBy"),
        F.array(F.struct(F.concat(F.lit("t"), text(n % 40)).alias("id"), F.lit("User").alias("type"))).alias(
            "targetResources"
        ),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("result"),
        F.when(F.col("event_type") == "error", F.lit("denied")).alias("resultReason"),
    )
    return events(b).select(F.to_json(record).alias("value"))


def entra_sign_ins(b) -> DataFrame:
    n, user = F.col("n"), text("user_id")
    record = F.struct(
        F.concat(F.lit("s-"), text(n)).alias("id"),
        iso_seconds(F.col("ts")).alias("createdDateTime"),
        F.struct(F.when(F.col("event_type") == "error", 50126).otherwise(0).alias("errorCode")).alias("status"),
        F.when(n % 4 == 0, F.array(F.lit("totp"))).alias("authenticationMethodsUsed"),
        F.struct(
            F.when(n % 2 == 0, F.lit("Oslo")).alias("city"), F.lit("NO").alias("countryOrRegion")
        ).alias("location"),
        F.struct(F.lit("Linux").alias("operatingSystem")).alias("deviceDetail"),
        F.concat(F.lit("u"), user, F.lit("@t")).alias("userPrincipalName"),
        F.when(n % 5 != 0, F.lit("Mail")).alias("appDisplayName"),
    )
    return events(b).select(F.to_json(record).alias("value"))


# --- directories ----------------------------------------------------------------------


def customers(b) -> DataFrame:
    return b.table("customer").withColumn("k", F.col("c_custkey"))


def iam_users(b) -> DataFrame:
    """Account-export user entries, one JSON text per customer."""
    k = F.col("k")
    arn = F.concat(F.lit("arn:aws:iam::1:user/u"), text(k))
    document = F.concat(
        F.lit('{"Statement": [{"Effect": "Allow", "Action": '),
        F.when(k % 3 == 0, F.lit('"iam:PassRole"')).when(k % 3 == 1, F.lit('["s3:GetObject", "lambda:CreateFunction"]'))
        .otherwise(F.lit('["ec2:*"]')),
        F.lit(', "Resource": "arn:aws:s3:::b'), text(k % 50),
        F.lit('"}, {"Effect": "Deny", "Action": "*", "Resource": "*"}]}'),
    )
    record = F.struct(
        arn.alias("Arn"),
        F.concat(F.lit("u"), text(k)).alias("UserName"),
        F.when(k % 4 == 0, F.lit("2001-06-01T00:00:00Z")).alias("PasswordLastUsed"),
        F.when(k % 4 == 1, F.lit("{}")).alias("LoginProfile"),
        F.lit("1999-01-01T00:00:00").alias("CreateDate"),
        F.array(F.concat(F.lit("g"), text(k % 12))).alias("GroupList"),
        F.array(
            F.struct(
                F.concat(F.lit("inline"), text(k % 3)).alias("PolicyName"),
                F.when(k % 2 == 0, F.replace(F.url_encode(document), F.lit("+"), F.lit("%20")))
                .otherwise(document).alias("PolicyDocument"),
            )
        ).alias("UserPolicyList"),
        F.array(
            F.struct(
                pick(("AdministratorAccess", "ReadOnly", "AmazonS3FullAccess"), k % 3).alias("PolicyName"),
                F.concat(F.lit("arn:aws:iam::aws:policy/p"), text(k % 3)).alias("PolicyArn"),
            )
        ).alias("AttachedManagedPolicies"),
    )
    return customers(b).select(F.to_json(record).alias("value"))


def iam_groups(b) -> DataFrame:
    """Ten groups' worth of entries, repeated over the suppliers (g10 and g11 do not exist)."""
    s = F.col("s_suppkey") % 10
    record = F.struct(
        F.concat(F.lit("arn:aws:iam::1:group/g"), text(s)).alias("Arn"),
        F.concat(F.lit("g"), text(s)).alias("GroupName"),
    )
    return b.table("supplier").select(F.to_json(record).alias("value")).distinct()


def iam_roles(b) -> DataFrame:
    """Role entries with trust documents, one per part."""
    p = F.col("p_partkey")
    foreign = F.concat(F.lit("arn:aws:iam::"), text(p % 3 + 1), F.lit(":root"))
    trust = (
        F.when(p % 5 == 0, F.lit('{"Statement": [{"Effect": "Allow", "Principal": "*"}]}'))
        .when(p % 5 == 1, F.lit('{"Statement": {"Effect": "Allow", "Principal": {"AWS": "*"}}}'))
        .when(
            p % 5 == 2,
            F.concat(F.lit('{"Statement": [{"Effect": "Allow", "Principal": {"AWS": "'), foreign, F.lit('"}}]}')),
        )
        .when(
            p % 5 == 3,
            F.concat(
                F.lit('{"Statement": [{"Effect": "Allow", "Principal": {"AWS": ["'), foreign,
                F.lit('"], "Service": "ec2.amazonaws.com"}, "Condition": {"Bool": {"x": "y"}}}]}'),
            ),
        )
    )
    record = F.struct(
        F.concat(F.lit("arn:aws:iam::1:role/r"), text(p)).alias("Arn"),
        pick(("deploy", "chat-agent", "reporting"), p % 3).alias("RoleName"),
        trust.alias("AssumeRolePolicyDocument"),
    )
    return b.table("part").select(F.to_json(record).alias("value"))


def policy_files(b) -> DataFrame:
    """Policy files (name, text) in the three shapes, one per part."""
    p = F.col("p_partkey")
    action = (
        F.when(p % 4 == 0, F.lit('["iam:CreateUser", "s3:GetObject", "iam:CreateUser"]'))
        .when(p % 4 == 1, F.lit('"s3:*"'))
        .when(p % 4 == 2, F.lit('["s3:GetObject"]'))
        .otherwise(F.lit("[]"))
    )
    document = F.concat(
        F.lit('{"Version": "2012-10-17", "Statement": {"Effect": "Allow", "Action": '), action,
        F.lit(', "Resource": "*"}}'),
    )
    shape = (
        F.when(p % 3 == 0, F.concat(F.lit('{"PolicyVersion": {"Document": '), document, F.lit("}}")))
        .when(p % 3 == 1, F.concat(F.lit('{"privesc": true, "document": '), document, F.lit("}")))
        .otherwise(document)
    )
    return b.table("part").select(F.concat(F.lit("policy"), text(p)).alias("name"), shape.alias("text"))


def okta_directory(b) -> dict[str, DataFrame]:
    """Okta export tables: users and factors per customer, groups and apps per part, links per order line."""
    k, p = F.col("k"), F.col("p_partkey")
    users = customers(b).select(
        F.concat(F.lit("u"), text(k)).alias("id"),
        pick(
            ("ACTIVE", "STAGED", "PROVISIONED", "SUSPENDED", "DEPROVISIONED", "LOCKED_OUT", "OTHER"), k % 7
        ).alias("status"),
        F.lit("2000-01-01T00:00:00.000Z").alias("created"),
        F.when(k % 3 == 0, F.lit("2001-01-01T00:00:00.000Z")).alias("lastLogin"),
        F.lit(None).cast("string").alias("lastUpdated"),
        F.struct(
            F.when(k % 5 != 0, F.lit("Ann")).alias("firstName"),
            F.when(k % 5 != 0, F.concat(F.lit("Lee"), text(k))).alias("lastName"),
            F.concat(F.lit("u"), text(k), F.lit("@corp.test")).alias("email"),
            F.lit(None).cast("string").alias("login"), F.col("c_mktsegment").alias("department"),
            F.lit(None).cast("string").alias("managerId"),
            F.when(k % 9 == 0, F.lit("Service")).alias("userType"), F.lit(None).cast("string").alias("title"),
        ).alias("profile"),
    )
    factors = customers(b).where(k % 2 == 0).select(
        F.concat(F.lit("u"), text(k)).alias("user_id"), F.lit("push").alias("factorType"),
        F.when(k % 4 == 0, "ACTIVE").otherwise("PENDING").alias("status"),
    )
    groups = b.table("part").select(
        F.concat(F.lit("g"), text(p)).alias("id"), F.lit("OKTA_GROUP").alias("type"),
        F.struct(
            F.concat(pick(("Admins", "Owners", "Staff"), p % 3), F.lit(" "), text(p)).alias("name"),
            F.lit(None).cast("string").alias("description"),
        ).alias("profile"),
    )
    apps = b.table("part").select(
        F.concat(F.lit("a"), text(p)).alias("id"),
        F.concat(pick(("AWS", "Slack", "Wiki", "GitHub"), p % 4), F.lit(" "), text(p)).alias("label"),
        F.lit(None).cast("string").alias("name"), F.lit("SAML_2_0").alias("signOnMode"),
        F.lit("ACTIVE").alias("status"),
    )
    line = bind.lines(b.spark, b.sf_dir)
    user_id = F.concat(F.lit("u"), text("o_custkey"))
    return {
        "users": users,
        "factors": factors,
        "groups": groups,
        "apps": apps,
        "user_groups": line.where(F.col("l_linenumber") <= 2).select(
            user_id.alias("user_id"), F.concat(F.lit("g"), text("l_partkey")).alias("group_id")
        ).distinct(),
        "app_links": line.where(F.col("l_linenumber") == 3).select(
            user_id.alias("user_id"), F.concat(F.lit("a"), text("l_partkey")).alias("appInstanceId"),
            F.lit(None).cast("string").alias("id"), F.lit("app").alias("appName"),
            F.lit(None).cast("string").alias("label"),
        ).distinct(),
        "roles": customers(b).where(k % 10 == 0).select(
            F.concat(F.lit("u"), text(k)).alias("user_id"),
            pick(("SUPER_ADMIN", "APP_ADMIN", "CUSTOM"), _div(k, 10) % 3).alias("type"),
            F.lit(None).cast("string").alias("label"), F.lit("2000-05-05T00:00:00Z").alias("created"),
        ),
    }


def _div(column: Column, n: int) -> Column:
    return F.floor(column / n).cast("bigint")


ENTRA_ROLES = ("Global Administrator", "User Administrator", "Directory Readers", "Billing Administrator")


def entra_directory(b) -> dict[str, DataFrame]:
    k, p = F.col("k"), F.col("p_partkey")
    nothing = F.lit(None).cast("string")
    line = bind.lines(b.spark, b.sf_dir)
    return {
        "users": customers(b).select(
            F.concat(F.lit("u"), text(k)).alias("id"), F.col("c_name").alias("displayName"),
            F.concat(F.lit("u"), text(k), F.lit("@t")).alias("userPrincipalName"),
            F.when(k % 3 == 0, F.concat(F.lit("m"), text(k), F.lit("@t"))).alias("mail"),
            F.when(k % 6 == 0, F.lit("Guest")).alias("userType"), (k % 5 != 0).alias("accountEnabled"),
            F.col("c_mktsegment").alias("department"), nothing.alias("jobTitle"),
            F.lit("2001-01-01T00:00:00Z").alias("lastSignInDateTime"), nothing.alias("createdDateTime"),
        ),
        "service_principals": b.table("part").select(
            F.concat(F.lit("sp"), text(p)).alias("id"),
            pick(("Mailer", "Copilot for sales", "Backup"), p % 3).alias("displayName"),
            nothing.alias("appId"), nothing.alias("servicePrincipalType"), F.lit(True).alias("accountEnabled"),
            F.when(p % 7 == 0, F.array(F.lit("MyAgentTag"))).alias("tags"),
        ),
        "groups": b.table("supplier").select(
            F.concat(F.lit("g"), text("s_suppkey")).alias("id"), F.col("s_name").alias("displayName"),
            nothing.alias("description"), F.array().cast("array<string>").alias("groupTypes"),
            F.lit(True).alias("securityEnabled"), F.lit(False).alias("mailEnabled"),
        ),
        "roles": b.table("part").select(
            F.concat(F.lit("r"), text(p)).alias("id"), pick(ENTRA_ROLES, p % 4).alias("displayName"),
            nothing.alias("description"), nothing.alias("roleTemplateId"),
        ),
        "role_members": line.where(F.col("l_linenumber") == 1).select(
            F.concat(F.lit("r"), text("l_partkey")).alias("role_id"),
            F.concat(F.lit("u"), text("o_custkey")).alias("member_id"),
        ).distinct(),
        "member_of": line.where(F.col("l_linenumber") == 2).select(
            F.concat(F.lit("u"), text("o_custkey")).alias("user_id"),
            F.concat(F.lit("g"), text("l_suppkey")).alias("target_id"),
        ).distinct(),
        "applications": b.table("part").select(
            F.concat(F.lit("app"), text(p)).alias("id"), F.col("p_name").alias("displayName"),
            nothing.alias("appId"), nothing.alias("createdDateTime"),
        ),
        "app_role_assignments": line.where(F.col("l_linenumber") == 3).select(
            F.concat(F.lit("u"), text("o_custkey")).alias("user_id"),
            text(F.col("l_partkey") % 5).alias("appRoleId"), text("l_suppkey").alias("resourceId"),
            F.lit("Portal").alias("resourceDisplayName"), F.lit("2000-01-01T00:00:00Z").alias("createdDateTime"),
        ).distinct(),
    }


ERP_KEYS = ("TRAN_PURCHORD", "TRAN_VENDBILL", "LIST_VENDOR", "ADMI_SETUP", "REPT_OTHER", "TRAN_JOURNAL")


def erp_tables(b) -> dict[str, DataFrame]:
    k, p = F.col("k"), F.col("p_partkey")
    line = bind.lines(b.spark, b.sf_dir)
    rights = b.table("part").select(
        text(p % 500).alias("role"), pick(ERP_KEYS, p % 6).alias("permkey"), (p % 5).cast("int").alias("permlevel")
    ).distinct()
    return {
        "employee": customers(b).select(
            text(k).alias("id"), F.concat(F.lit("e"), text(k), F.lit("@corp.test")).alias("email"),
            F.when(k % 4 != 0, F.lit("Eve")).alias("firstname"),
            F.when(k % 4 != 0, F.concat(F.lit("Fox"), text(k))).alias("lastname"),
            pick(("F", "T", "f", "t"), k % 4).alias("isinactive"), F.col("c_mktsegment").alias("department"),
            F.when(k > 0, text(_div(k, 10))).alias("supervisor"), F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("string").alias("hiredate"),
        ),
        "role": b.table("part").select(text(p % 500).alias("id"), F.concat(F.lit("Role "), text(p % 500)).alias("name")).distinct(),
        "rolepermissions": rights,
        "employeeroles": line.select(
            text("o_custkey").alias("employee_id"), text(F.col("l_partkey") % 600).alias("role_id")
        ).distinct(),
        "subsidiary": b.table("supplier").select(text("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    }


ERP_ROLE_NAMES = (
    "Company Controller", "Revenue Accountant", "AP Clerk", "Shared Services Lead", "Fixed Assets Manager",
    "Human Resources", "Buyer", "Custom EFT Role", "Messenger", "Credit & Collections Manager", "Warehouse",
)


def audit_document(b) -> dict[str, DataFrame]:
    """Audit tables in the shape the document reader gives, derived from order lines."""
    line = bind.lines(b.spark, b.sf_dir)
    role = pick(ERP_ROLE_NAMES, F.col("l_partkey") % 11)
    employee_role = line.groupBy(
        F.concat(F.lit("Emp "), text("o_custkey")).alias("name"), role.alias("role")
    ).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("role_pos"))
    rule = pick(
        ("JE_create_approve", "vendor_pay", "creditmemo_payment", "customer_creditmemo", "customer_refund",
         "invoice_payment", "unheard_of"), F.col("o_custkey") % 7,
    )
    violator = line.select("o_custkey").distinct().select(
        rule.alias("rule_key"), F.col("o_custkey").alias("pos"),
        F.concat(F.lit("Emp "), text("o_custkey")).alias("name"),
        F.array(F.lit("AP Clerk"), F.lit("Buyer"), F.lit("Messenger")).alias("roles"),
    )
    employee = customers(b).where(F.col("k") % 3 != 0).select(F.concat(F.lit("Emp "), text("k")).alias("name"))
    return {
        "employee": employee,
        "role": b.table("part").select(pick(ERP_ROLE_NAMES, F.col("p_partkey") % 11).alias("name")).distinct(),
        "employee_role": employee_role,
        "violator": violator,
    }


HEALTH_ROLE_NAMES = (
    "Attending Physician", "Clinical Staff", "Billing Clerk", "IT System Admin", "AI Clinical Scribe",
    "Pharmacy Tech", "Break-Glass Emergency", "Unlisted",
)
HEALTH_TYPES = (
    "unauthorized_record_access", "peer_deviation", "break_glass_abuse", "dormant_contractor",
    "ai_agent_scope_drift", "cross_system_aggregation", "missing_mfa", "excessive_export",
    "celebrity_snooping", "not_a_type",
)
TRADING_ROLE_NAMES = (
    "Trader — Equities", "Trader — Fixed Income", "Compliance Officer", "Research Analyst", "Block Trader",
    "Settlement Operations", "AI Pre-Trade Analytics",
)
TRADING_TYPES = (
    "chinese_wall_breach", "block_trade_front_running", "mnpi_access", "compliance_trading_violation",
    "cross_desk_access", "dormant_terminated", "ai_agent_scope_drift", "ai_chinese_wall_breach",
    "excessive_trading_access", "missing_mfa_trading", "not_a_type",
)
DEPARTMENTS = ("Psychiatry", "ICU", "Cardiology", "Oncology", "Radiology")
DESKS = ("DESK-EQ", "DESK-FI", "DESK-RES", "DESK-COMP", "DESK-XX")


def _entities(b, roles, trading: bool) -> DataFrame:
    from gatewarden.sources.tenants import ENTITY
    from pyspark.sql import types as T

    k = F.col("k")
    given = customers(b).select(
        F.concat(F.lit("E-"), text(k)).alias("id"), F.col("c_name").alias("name"),
        pick(roles, k % len(roles)).alias("role"),
        pick(DEPARTMENTS, k % 5).alias("department"), F.lit("FAC").alias("facility"),
        pick(DESKS, k % 5).alias("desk"),
        pick(("human", "ai_agent", "service_account", "human"), k % 4).alias("type"),
        F.when(k % 6 == 0, "terminated").otherwise("active").alias("status"),
        (k % 200).cast("int").alias("last_login_days_ago"), F.when(k % 5 != 0, k % 2 == 0).alias("mfa"),
        pick(("active", "terminated", "agent") if trading else ("provider", "contractor", "agent"), k % 3)
        .alias("origin"),
    )
    absent = [
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in T.StructType.fromDDL(ENTITY).fields
        if f.name not in given.columns
    ]
    return given.select("*", *absent)


def _violations(b, types) -> DataFrame:
    k = F.col("k")
    evidence = F.to_json(
        F.struct(
            F.when(k % 2 == 0, text(k)).alias("records_accessed"),
            (k % 90).alias("records_accessed_30d"), F.array(F.lit("A"), F.lit("B")).alias("departments_accessed"),
            F.when(k % 3 == 0, F.lit("Wall 1")).alias("information_barrier"), (k % 2 == 0).alias("mfa_enabled"),
            F.when(k % 4 == 0, F.lit("Desk X")).alias("restricted_resource"),
            (k % 3 == 0).alias("care_team_member"),
        )
    )
    return customers(b).select(
        F.concat(F.lit("V-"), text(k)).alias("id"), pick(types, k % len(types)).alias("type"),
        F.concat(F.lit("E-"), text(k + (k % 8 == 7).cast("int") * 100000000)).alias("subject_id"),
        F.concat(F.lit("finding "), text(k)).alias("description"), F.lit("high").alias("severity"),
        (F.lit(0.8) + (k % 20) / 100.0).alias("confidence"), evidence.alias("evidence"),
    )


def health_tables(b) -> dict[str, DataFrame]:
    from gatewarden.sources.tenants import HEALTH_ROLE
    from pyspark.sql import types as T  # noqa: F401

    s = F.col("s_suppkey")
    roles = b.table("part").select(
        pick(HEALTH_ROLE_NAMES[:7], F.col("p_partkey") % 7).alias("role")
    ).distinct().select(
        "role", F.array(F.lit("read")).alias("actions"), F.lit("assigned").alias("scope"),
        F.contains("role", F.lit("Admin")).alias("is_privileged"), F.lit("").alias("description"),
    )
    return {
        "facilities": b.table("supplier").select(
            F.concat(F.lit("FAC"), text(s)).alias("id"), F.col("s_name").alias("name"),
            F.lit("hospital").alias("type"),
            F.array(pick(DEPARTMENTS, s % 5), F.lit("Emergency")).alias("departments"),
        ),
        "roles": roles,
        "entities": _entities(b, HEALTH_ROLE_NAMES, trading=False),
        "violations": _violations(b, HEALTH_TYPES),
    }


def trading_tables(b) -> dict[str, DataFrame]:
    s = F.col("s_suppkey")
    roles = b.table("part").select(
        pick(TRADING_ROLE_NAMES, F.col("p_partkey") % 7).alias("role")
    ).distinct().select(
        "role", F.array(F.lit("execute_order"), F.lit("view_book")).alias("actions"), F.lit("desk").alias("scope"),
        F.contains("role", F.lit("Compliance")).alias("is_privileged"),
        F.array(F.lit("DESK-EQ")).alias("desk_access"), F.contains("role", F.lit("Block")).alias("mnpi_access"),
        F.contains("role", F.lit("Research")).alias("chinese_wall"), F.lit(False).alias("restricted_trading"),
        F.startswith("role", F.lit("AI")).alias("is_agent"),
    )
    return {
        "desks": b.table("supplier").select(
            F.concat(F.lit("D"), text(s)).alias("id"), F.col("s_name").alias("name"),
            F.when(s % 2 == 0, "front-office").otherwise("back-office").alias("division"),
            F.lit("equities").alias("asset_class"), F.when(s % 7 == 0, F.lit(True)).alias("is_restricted"),
            F.lit(None).cast("string").alias("restriction_note"),
        ),
        "barriers": b.table("nation").select(
            F.concat(F.lit("IB-"), text("n_nationkey")).alias("id"), F.col("n_name").alias("name"),
            F.array(pick(DESKS, F.col("n_nationkey") % 5)).alias("side_a"),
            F.array(pick(DESKS, (F.col("n_nationkey") + 1) % 5), pick(DESKS, (F.col("n_nationkey") + 2) % 5)).alias(
                "side_b"
            ),
            F.lit("rule").alias("regulation"), F.lit("").alias("description"),
        ),
        "roles": roles,
        "entities": _entities(b, TRADING_ROLE_NAMES, trading=True),
        "violations": _violations(b, TRADING_TYPES),
    }


def admins(b) -> DataFrame:
    """Administrator posture rows, one per customer, five tenants."""
    k = F.col("k")
    return customers(b).select(
        F.concat(F.lit("tenant"), text(F.col("c_nationkey") % 5)).alias("tenant"),
        F.concat(F.lit("adm"), text(k)).alias("name"), F.col("c_name").alias("display_name"),
        pick(("Super Administrator", "Organization Administrator", "Help Desk Administrator"), k % 3).alias("role"),
        pick(("sms", "push", "email", "webauthn", "none"), k % 5).alias("mfa_method"),
        F.to_timestamp(F.lit("2001-12-31 00:00:00")).alias("__end"), k.alias("__k"),
        F.lit("active").alias("status"),
        F.when(k % 4 == 0, "service_account").otherwise("human").alias("type"), F.lit("IT").alias("department"),
        (k % 300).cast("int").alias("api_token_age_days"),
    ).withColumn("last_login", F.col("__end") - F.make_dt_interval((F.col("__k") % 200).cast("int"))).drop("__end", "__k")


def tenants(b) -> DataFrame:
    key = F.col("n_nationkey") % 5
    return b.table("nation").select(
        F.concat(F.lit("tenant"), text(key)).alias("tenant"), (F.lit(24) * (key + 1)).cast("int").alias("session_max_lifetime_hours"),
        (key % 2 == 0).alias("threat_insight_enabled"),
    ).distinct()
