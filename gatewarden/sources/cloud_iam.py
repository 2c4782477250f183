"""Cloud account exports: users, groups, roles, their policies and trust documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewarden.functions import fixed_values as fixed
from gatewarden.functions.scalars import contains_any, entity_id, iso_timestamp, starts_with_any
from gatewarden.plans.joins import skew_join
from gatewarden.schemas import Estate, nested
from gatewarden.sources.canonical import conform

SOURCE = "aws_iam"

INLINE = "array<struct<PolicyName:string,PolicyDocument:string>>"
ATTACHED = "array<struct<PolicyName:string,PolicyArn:string>>"
TAGS = "array<struct<Key:string,Value:string>>"
USER = (
    f"Arn string, UserName string, Path string, CreateDate string, PasswordLastUsed string, "
    f"LoginProfile string, Tags {TAGS}, GroupList array<string>, UserPolicyList {INLINE}, "
    f"AttachedManagedPolicies {ATTACHED}"
)
GROUP = (
    f"Arn string, GroupName string, Path string, CreateDate string, GroupPolicyList {INLINE}, "
    f"AttachedManagedPolicies {ATTACHED}"
)
ROLE = (
    f"Arn string, RoleName string, Path string, CreateDate string, RoleLastUsed struct<LastUsedDate:string>, "
    f"Tags {TAGS}, AssumeRolePolicyDocument string, MaxSessionDuration int, RolePolicyList {INLINE}, "
    f"AttachedManagedPolicies {ATTACHED}"
)
POLICY = "Arn string, PolicyName string, PolicyVersionList array<struct<IsDefaultVersion:boolean,Document:string>>"


DOCUMENT = (
    f"UserDetailList array<{nested(USER)}>, GroupDetailList array<{nested(GROUP)}>, "
    f"RoleDetailList array<{nested(ROLE)}>, Policies array<{nested(POLICY)}>"
)


def read_account_details(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Users, groups, roles and policies of all export pages below a folder."""
    pages = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return {
        name: pages.select(F.inline(column))
        for name, column in (
            ("users", "UserDetailList"), ("groups", "GroupDetailList"),
            ("roles", "RoleDetailList"), ("policies", "Policies"),
        )
    }


# --- policy documents ---------------------------------------------------------


def decoded(document: Column) -> Column:
    """Policy document as JSON text, whether it came as an object or URL-encoded."""
    unquoted = F.try_url_decode(F.replace(document, F.lit("+"), F.lit("%2B")))
    return F.when(F.startswith(F.ltrim(document), F.lit("{")), document).otherwise(unquoted)


def statements(document: Column) -> Column:
    """Statements of a decoded document as an array of variants (one object or a list)."""
    whole = F.try_parse_json(document)
    shape = F.schema_of_variant(F.try_variant_get(whole, "$.Statement", "variant"))
    return (
        F.when(F.startswith(shape, F.lit("ARRAY")), F.try_variant_get(whole, "$.Statement", "array<variant>"))
        .when(F.startswith(shape, F.lit("OBJECT")), F.array(F.try_variant_get(whole, "$.Statement", "variant")))
        .otherwise(F.array().cast("array<variant>"))
    )


def strings_at(value: Column, path: str) -> Column:
    """A string or a list of strings, always as a list."""
    shape = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return (
        F.when(F.startswith(shape, F.lit("ARRAY")), F.try_variant_get(value, path, "array<string>"))
        .when(shape == "STRING", F.array(F.try_variant_get(value, path, "string")))
        .otherwise(F.array().cast("array<string>"))
    )


def allowed(statement_list: Column, element: str) -> Column:
    """All actions or resources of the Allow statements, in order, repeats kept."""
    granting = F.filter(
        statement_list, lambda s: F.coalesce(F.try_variant_get(s, "$.Effect", "string") == "Allow", F.lit(False))
    )
    return F.flatten(F.transform(granting, lambda s: strings_at(s, f"$.{element}")))


RISK_REGEX = "(?i)(" + "|".join(fixed.RISK_VERBS) + ")"


def risk_keywords(actions: Column) -> Column:
    """Risky verbs inside the actions: lower-cased, distinct, sorted."""
    found = F.transform(actions, lambda a: F.regexp_extract_all(F.coalesce(a, F.lit("")), F.lit(RISK_REGEX), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(F.flatten(found), lambda w: F.lower(w))))


def is_privileged(actions: Column) -> Column:
    """High-risk action, any action of an identity service, or a wildcard."""
    return F.exists(
        actions,
        lambda a: a.isin(*fixed.HIGH_RISK_ACTIONS)
        | starts_with_any(a, fixed.PRIVILEGED_SERVICES)
        | (a == "*")
        | F.endswith(a, F.lit(":*")),
    )


# --- resources ------------------------------------------------------------------


def sensitivity_of(arn: Column) -> Column:
    text = F.lower(arn)
    return (
        F.when(contains_any(text, ("secretsmanager", "kms", "iam", "organizations")), "critical")
        .when(contains_any(text, ("s3", "rds", "dynamodb", "ecr")), "high")
        .when(contains_any(text, ("lambda", "ec2", "ecs", "sqs", "sns")), "medium")
        .otherwise("low")
    )


def resource_type_of(arn: Column) -> Column:
    parts = F.split(arn, ":")
    return F.when(F.size(parts) >= 3, F.concat(F.get(parts, 2), F.lit("_resource"))).otherwise("aws_resource")


def resources_of(policies: DataFrame, source: str = SOURCE) -> DataFrame:
    """Distinct resources named by policies (column ``resources``); ``*`` names none."""
    arn = F.col("arn")
    last = F.element_at(F.split(arn, ":"), -1)
    return (
        policies.select(F.explode("resources").alias("arn"))
        .where((arn != "*") & arn.isNotNull())
        .distinct()
        .select(
            entity_id(source, arn).alias("id"), F.lit(source).alias("source"),
            resource_type_of(arn).alias("type"),
            F.when(last == "", arn).otherwise(last).alias("name"),
            sensitivity_of(arn).alias("sensitivity"), "arn",
            F.to_json(F.struct("arn")).alias("attributes"),
        )
    )


# --- subjects ----------------------------------------------------------------------


def _tag(tags: Column, key: str) -> Column:
    return F.try_element_at(F.filter(tags, lambda t: t["Key"] == key), F.lit(1))["Value"]


def user_subjects(users: DataFrame) -> DataFrame:
    """Users: no console access at all makes a service account."""
    arn = F.col("Arn")
    no_console = F.col("PasswordLastUsed").isNull() & F.col("LoginProfile").isNull()
    return conform(
        users.select(
            entity_id(SOURCE, arn).alias("id"), arn.alias("external_id"), F.lit(SOURCE).alias("source"),
            F.when(no_console, "service_account").otherwise("human").alias("type"),
            F.col("UserName").alias("display_name"),
            _tag(F.col("Tags"), "email").alias("email"),
            F.lit("active").alias("status"),
            iso_timestamp(F.col("PasswordLastUsed")).alias("last_seen"),
            F.lit(False).alias("mfa_enabled"),
            F.to_json(F.struct(arn.alias("arn"), F.coalesce("Path", F.lit("/")).alias("path"))).alias("attributes"),
            iso_timestamp(F.col("CreateDate")).alias("created_at"),
        ),
        "subject",
    )


def group_subjects(groups: DataFrame) -> DataFrame:
    arn = F.col("Arn")
    return conform(
        groups.select(
            entity_id(SOURCE, arn).alias("id"), arn.alias("external_id"), F.lit(SOURCE).alias("source"),
            F.lit("group").alias("type"), F.col("GroupName").alias("display_name"),
            F.lit("active").alias("status"),
            F.to_json(F.struct(arn.alias("arn"), F.coalesce("Path", F.lit("/")).alias("path"))).alias("attributes"),
            iso_timestamp(F.col("CreateDate")).alias("created_at"),
        ),
        "subject",
    )


# Fixed value: tag that marks a role as used by an agent.
AGENT_TAG_SUFFIX = ":type"
AGENT_WORDS = ("agent", "ai", "llm")


def role_subjects(roles: DataFrame, own_account: str) -> DataFrame:
    """Roles, with what their trust documents allow."""
    arn, name = F.col("Arn"), F.col("RoleName")
    tagged = F.exists(
        F.coalesce("Tags", F.array().cast(TAGS)),
        lambda t: F.endswith(t["Key"], F.lit(AGENT_TAG_SUFFIX)) & (t["Value"] == "agent"),
    )
    trust = trust_analysis(F.col("AssumeRolePolicyDocument"), own_account)
    return conform(
        roles.withColumn("trust", trust).select(
            entity_id(SOURCE, arn).alias("id"), arn.alias("external_id"), F.lit(SOURCE).alias("source"),
            F.when(tagged | contains_any(F.lower(name), AGENT_WORDS), "ai_agent")
            .otherwise("service_account").alias("type"),
            name.alias("display_name"), F.lit("active").alias("status"),
            iso_timestamp(F.col("RoleLastUsed.LastUsedDate")).alias("last_seen"),
            F.to_json(
                F.struct(
                    arn.alias("arn"), F.coalesce("Path", F.lit("/")).alias("path"),
                    F.col("MaxSessionDuration").alias("max_session_duration"),
                    F.col("trust.service_principals").alias("service_principals"),
                    F.col("trust.federated_principals").alias("federated_principals"),
                )
            ).alias("attributes"),
            F.col("trust.trust_policy_open").alias("trust_policy_open"),
            F.col("trust.cross_account_trust").alias("cross_account_trust"),
            F.col("trust.cross_account_no_conditions").alias("cross_account_no_conditions"),
            F.col("trust.cross_account_ids").alias("cross_account_ids"),
            iso_timestamp(F.col("CreateDate")).alias("created_at"),
        ),
        "subject",
    )


def trust_analysis(document: Column, own_account: str) -> Column:
    """Struct with trust_policy_open, cross_account_trust, cross_account_ids,
    cross_account_no_conditions, service_principals and federated_principals.

    NULL for a role without a trust document. A statement without conditions flags
    the role once any foreign account was trusted up to and including it.
    """
    empty = F.array().cast("array<string>")

    def principal_kind(s: Column) -> Column:
        return F.schema_of_variant(F.try_variant_get(s, "$.Principal", "variant"))

    def examine(s: Column) -> Column:
        kind = principal_kind(s)
        text = F.try_variant_get(s, "$.Principal", "string")
        only_star = F.replace(text, F.lit(" "), F.lit("")) == '{"AWS":"*"}'
        open_statement = F.coalesce(((kind == "STRING") & (text == "*")) | only_star, F.lit(False))
        accounts = F.when(open_statement, empty).otherwise(strings_at(s, "$.Principal.AWS"))
        named = F.filter(
            accounts,
            lambda p: (p != "*") & (F.contains(p, F.lit(":root")) | F.contains(p, F.lit("arn:aws:iam::"))),
        )
        foreign = F.filter(
            F.transform(named, lambda p: F.get(F.split(p, ":"), 4)),
            lambda a: a.isNotNull() & (a != "") & (a != own_account),
        )
        condition = F.try_variant_get(s, "$.Condition", "string")
        return F.struct(
            open_statement.alias("skip"),
            (open_statement | F.array_contains(accounts, "*")).alias("open"),
            foreign.alias("foreign"),
            F.when(open_statement, empty).otherwise(strings_at(s, "$.Principal.Service")).alias("services"),
            F.when(open_statement, empty).otherwise(strings_at(s, "$.Principal.Federated")).alias("federated"),
            F.coalesce(condition.isNull() | (condition == "{}"), F.lit(True)).alias("unconditional"),
        )

    granting = F.filter(
        statements(decoded(document)),
        lambda s: F.coalesce(F.try_variant_get(s, "$.Effect", "string") == "Allow", F.lit(False)),
    )
    examined = F.transform(granting, examine)
    folded = F.aggregate(
        examined,
        F.struct(F.lit(False).alias("cross"), F.lit(False).alias("bare")),
        lambda acc, s: F.struct(
            (acc["cross"] | (F.size(s["foreign"]) > 0)).alias("cross"),
            (
                acc["bare"]
                | (~s["skip"] & s["unconditional"] & (acc["cross"] | (F.size(s["foreign"]) > 0)))
            ).alias("bare"),
        ),
    )
    return F.when(
        document.isNotNull(),
        F.struct(
            F.exists(examined, lambda s: s["open"]).alias("trust_policy_open"),
            folded["cross"].alias("cross_account_trust"),
            F.flatten(F.transform(examined, lambda s: s["foreign"])).alias("cross_account_ids"),
            folded["bare"].alias("cross_account_no_conditions"),
            F.flatten(F.transform(examined, lambda s: s["services"])).alias("service_principals"),
            F.flatten(F.transform(examined, lambda s: s["federated"])).alias("federated_principals"),
        ),
    )


# --- permissions and assignments ---------------------------------------------------


def inline_policies(entities: DataFrame, policy_list: str) -> DataFrame:
    """Inline policies of users, groups or roles: subject_id, name, actions, resources, ...

    The id hashes name and document, so equal policies of many entities are one permission.
    """
    document = decoded(F.col("policy.PolicyDocument"))
    return (
        entities.select(entity_id(SOURCE, F.col("Arn")).alias("subject_id"), F.explode(policy_list).alias("policy"))
        .withColumn("document", document)
        .withColumn("statements", statements(F.col("document")))
        .withColumn("actions", allowed(F.col("statements"), "Action"))
        .withColumn("resources", allowed(F.col("statements"), "Resource"))
        .select(
            "subject_id",
            entity_id(
                SOURCE,
                F.concat(
                    F.lit("inline:"), F.col("policy.PolicyName"), F.lit(":"),
                    F.xxhash64("document").cast("string"),
                ),
            ).alias("id"),
            F.lit(SOURCE).alias("source"), F.col("policy.PolicyName").alias("name"),
            F.lit("policy").alias("type"), "actions", "resources",
            is_privileged(F.col("actions")).alias("is_privileged"),
            risk_keywords(F.col("actions")).alias("risk_keywords"),
            F.to_json(F.struct(F.lit(True).alias("inline"), "document")).alias("attributes"),
        )
    )


def managed_policies(entities: DataFrame) -> DataFrame:
    """Attached managed policies, known by name only: subject_id plus permission columns."""
    name, arn = F.col("policy.PolicyName"), F.col("policy.PolicyArn")
    return entities.select(
        entity_id(SOURCE, F.col("Arn")).alias("subject_id"), F.explode("AttachedManagedPolicies").alias("policy")
    ).select(
        "subject_id", entity_id(SOURCE, arn).alias("id"), F.lit(SOURCE).alias("source"), name.alias("name"),
        F.lit("policy").alias("type"),
        F.array().cast("array<string>").alias("actions"), F.array().cast("array<string>").alias("resources"),
        contains_any(F.lower(name), ("admin", "fullaccess", "poweruser")).alias("is_privileged"),
        risk_keywords(F.array(name)).alias("risk_keywords"),
        F.to_json(F.struct(arn.alias("arn"), F.lit(True).alias("managed"))).alias("attributes"),
    )


def with_policy_bodies(permissions: DataFrame, policies: DataFrame) -> DataFrame:
    """Opt-in: fill managed permissions from the export's policy list (default versions)."""
    body = F.filter("PolicyVersionList", lambda v: v["IsDefaultVersion"])
    bodies = (
        policies.select(
            entity_id(SOURCE, F.col("Arn")).alias("id"),
            statements(decoded(F.try_element_at(body, F.lit(1))["Document"])).alias("statements"),
        )
        .select(
            "id", allowed(F.col("statements"), "Action").alias("body_actions"),
            allowed(F.col("statements"), "Resource").alias("body_resources"),
        )
    )
    joined = permissions.join(bodies, "id", "left")
    filled = joined.withColumn("actions", F.coalesce("body_actions", "actions")).withColumn(
        "resources", F.coalesce("body_resources", "resources")
    )
    known = F.col("body_actions").isNotNull()
    return (
        filled.withColumn("is_privileged", F.when(known, is_privileged(F.col("actions"))).otherwise(F.col("is_privileged")))
        .withColumn("risk_keywords", F.when(known, risk_keywords(F.col("actions"))).otherwise(F.col("risk_keywords")))
        .drop("body_actions", "body_resources")
    )


def group_memberships(users: DataFrame, groups: DataFrame) -> DataFrame:
    """Membership assignments; the group acts as the permission, unknown names drop out."""
    named = groups.select(
        F.col("GroupName").alias("group_name"), entity_id(SOURCE, F.col("Arn")).alias("permission_id")
    )
    listed = users.select(
        entity_id(SOURCE, F.col("Arn")).alias("subject_id"), F.explode("GroupList").alias("group_name")
    )
    return conform(
        skew_join(listed, named, "group_name").select(
            F.concat_ws("/", F.lit("member"), "subject_id", "permission_id").alias("id"),
            "subject_id", "permission_id", F.lit(SOURCE).alias("source"), F.lit(SOURCE).alias("granted_by"),
            F.lit(True).alias("is_active"),
        ),
        "assignment",
    )


def with_mfa_devices(subject: DataFrame, devices: DataFrame) -> DataFrame:
    """MFA flag of users from a device list (UserName, one row per device); roles stay unknown."""
    counted = devices.groupBy(F.col("UserName").alias("user_name")).agg(F.count(F.lit(1)).alias("devices"))
    in_account = (
        F.col("type").isin("human", "service_account")
        & F.startswith("external_id", F.lit("arn:aws:iam"))
        & F.contains("external_id", F.lit(":user/"))
    )
    return (
        subject.withColumn("user_name", F.element_at(F.split("external_id", "/"), -1))
        .join(counted, "user_name", "left")
        .withColumn(
            "mfa_enabled",
            F.when(in_account, F.coalesce("devices", F.lit(0)) > 0).otherwise(F.col("mfa_enabled")),
        )
        .drop("user_name", "devices")
    )


def account_estate(details: dict[str, DataFrame], own_account: str, devices: DataFrame | None = None) -> Estate:
    """Canonical tables of one account export."""
    from gatewarden.operators.access import first_by
    from gatewarden.operators.escalation import detect_escalation_paths
    from gatewarden.schemas import empty_table

    users, groups, roles = details["users"], details["groups"], details["roles"]
    subject = user_subjects(users).unionByName(group_subjects(groups)).unionByName(
        role_subjects(roles, own_account)
    )
    if devices is not None:
        subject = with_mfa_devices(subject, devices)
    held = None
    for entities, policy_list in ((users, "UserPolicyList"), (groups, "GroupPolicyList"), (roles, "RolePolicyList")):
        part = inline_policies(entities, policy_list).unionByName(managed_policies(entities))
        held = part if held is None else held.unionByName(part)
    permission = conform(first_by(held.drop("subject_id"), ["id"], [F.col("name")]), "permission")
    grants = conform(
        held.select("subject_id", F.col("id").alias("permission_id")).distinct().select(
            F.concat_ws("/", "subject_id", "permission_id").alias("id"), "subject_id", "permission_id",
            F.lit(SOURCE).alias("source"), F.lit(True).alias("is_active"),
        ),
        "assignment",
    )
    spark = users.sparkSession
    estate = Estate(
        subject=subject,
        permission=permission,
        resource=conform(resources_of(held), "resource"),
        assignment=grants.unionByName(group_memberships(users, groups)),
        escalation_path=empty_table(spark, "escalation_path"),
        event=empty_table(spark, "event"),
    )
    return estate.with_tables(escalation_path=lambda: detect_escalation_paths(estate))


# --- directory of policy files ---------------------------------------------------------


def read_policy_directory(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of every policy file below a folder; the name is the file's stem."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.url_decode(name).alias("name"), F.col("value").alias("text")
    )


# Flags of the policy data set and the keywords they become.
DATASET_FLAGS = ("privesc", "resource_exposure", "credentials_exposure")
IDENTITY_VERBS = ("create", "delete", "attach", "put", "update")


def directory_permissions(files: DataFrame) -> DataFrame:
    """Permissions from policy files (name, text) in any of three shapes.

    The document sits under PolicyVersion.Document, under document, or is the
    file itself. Actions and resources are distinct and sorted; a file that allows
    nothing gives no permission.
    """
    whole = F.try_parse_json("text")
    nested = F.coalesce(
        F.try_variant_get(whole, "$.PolicyVersion.Document", "string"),
        F.try_variant_get(whole, "$.document", "string"),
        F.col("text"),
    )
    flag = {f: F.coalesce(F.try_variant_get(whole, f"$.{f}", "boolean"), F.lit(False)) for f in DATASET_FLAGS}
    parsed = files.withColumn("statements", statements(nested))
    for column, element in (("actions", "Action"), ("resources", "Resource")):
        parsed = parsed.withColumn(column, F.array_sort(F.array_distinct(allowed(F.col("statements"), element))))

    def wide(a: Column) -> Column:
        return (a == "*") | F.endswith(a, F.lit(":*"))

    keywords = F.concat(
        F.transform(F.filter("actions", wide), lambda a: F.concat(F.lit("wildcard:"), a)),
        F.filter(
            "actions",
            lambda a: starts_with_any(a, fixed.PRIVILEGED_SERVICES) & contains_any(F.lower(a), IDENTITY_VERBS),
        ),
        F.array_compact(F.array(*[F.when(flag[f], F.lit(f"mamip:{f}")) for f in DATASET_FLAGS])),
    )
    risky = F.exists("actions", lambda a: a.isin(*fixed.DIRECTORY_HIGH_RISK_ACTIONS) | wide(a))
    return conform(
        parsed.where(F.size("actions") > 0).select(
            entity_id(SOURCE, F.concat(F.lit("policy:"), F.col("name"))).alias("id"),
            F.lit(SOURCE).alias("source"), "name", F.lit("policy").alias("type"), "actions", "resources",
            (risky | flag["privesc"]).alias("is_privileged"),
            F.array_sort(keywords).alias("risk_keywords"),
        ),
        "permission",
    )
