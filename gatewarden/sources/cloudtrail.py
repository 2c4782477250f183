"""Cloud audit trail: readers and the two normalisation profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gatewarden.functions.scalars import as_of_lit, contains_any, fixed_map, iso_timestamp, starts_with_any
from gatewarden.schemas import ACTIVITY_EVENT, nested
from gatewarden.sources.files import first_files

SOURCE = "aws_cloudtrail"

IDENTITY = (
    "struct<type:string,arn:string,principalId:string,userName:string,accessKeyId:string,invokedBy:string,"
    "sessionContext:struct<sessionIssuer:struct<userName:string>>>"
)
RECORD = (
    f"eventID string, eventTime string, eventName string, eventSource string, awsRegion string, readOnly boolean, "
    f"userIdentity {IDENTITY}, requestParameters map<string,string>, resources array<struct<ARN:string>>, "
    f"sourceIPAddress string, userAgent string, errorCode string, errorMessage string"
)
LAKE_ROW = (
    "eventID string, eventTime string, eventName string, eventSource string, userIdentity string, "
    "requestParameters string, sourceIPAddress string, userAgent string, errorCode string, errorMessage string"
)

# Event names -> event types.
IAM_EVENTS = {
    "CreateUser": "iam.create_user",
    "DeleteUser": "iam.delete_user",
    "UpdateUser": "iam.modify_user",
    "CreateRole": "iam.create_role",
    "DeleteRole": "iam.delete_role",
    "AttachRolePolicy": "iam.attach_policy",
    "AttachUserPolicy": "iam.attach_policy",
    "AttachGroupPolicy": "iam.attach_policy",
    "DetachRolePolicy": "iam.detach_policy",
    "DetachUserPolicy": "iam.detach_policy",
    "DetachGroupPolicy": "iam.detach_policy",
    "PutRolePolicy": "iam.attach_policy",
    "PutUserPolicy": "iam.attach_policy",
    "DeleteRolePolicy": "iam.detach_policy",
    "DeleteUserPolicy": "iam.detach_policy",
    "CreateAccessKey": "iam.create_access_key",
    "UpdateAssumeRolePolicy": "iam.config_change",
    "CreatePolicy": "iam.config_change",
    "CreatePolicyVersion": "iam.config_change",
    "AddUserToGroup": "group.add_member",
    "RemoveUserFromGroup": "group.remove_member",
    "PassRole": "iam.pass_role",
}
STS_EVENTS = {
    "AssumeRole": "iam.assume_role",
    "AssumeRoleWithSAML": "iam.assume_role",
    "AssumeRoleWithWebIdentity": "iam.assume_role",
    "GetSessionToken": "auth.session_start",
    "GetFederationToken": "auth.session_start",
}
RESOURCE_EVENTS = {
    "RunInstances": "resource.create",
    "TerminateInstances": "resource.delete",
    "CreateBucket": "resource.create",
    "DeleteBucket": "resource.delete",
    "CreateFunction20150331": "resource.create",
    "CreateFunction": "resource.create",
    "DeleteFunction20150331": "resource.delete",
    "DeleteFunction": "resource.delete",
    "PutObject": "access.write",
    "GetObject": "access.read",
    "DeleteObject": "access.delete",
    "ListBuckets": "access.list",
    "ListObjects": "access.list",
    "ListObjectsV2": "access.list",
    "HeadObject": "access.read",
    "HeadBucket": "access.read",
    "DescribeInstances": "access.list",
    "DescribeSecurityGroups": "access.list",
    "GetBucketPolicy": "access.read",
    "GetBucketAcl": "access.read",
    "PutBucketPolicy": "access.admin",
}
# Privileged event names; the archive profile knows the first 21.
PRIVILEGED_EVENTS = (
    "CreateRole", "AttachRolePolicy", "PutRolePolicy", "CreateUser",
    "AttachUserPolicy", "PutUserPolicy", "PassRole", "CreateAccessKey",
    "UpdateAssumeRolePolicy", "AssumeRole", "CreatePolicy",
    "CreatePolicyVersion", "DeleteRole", "DeleteUser", "DeletePolicy",
    "PutBucketPolicy", "DeleteBucket", "RunInstances",
    "CreateFunction", "UpdateFunctionCode", "InvokeFunction",
    "GetSecretValue", "Decrypt",
)
ARCHIVE_PRIVILEGED_EVENTS = PRIVILEGED_EVENTS[:21]
CONFIG_EVENTS = (
    "CreateRole", "DeleteRole", "AttachRolePolicy", "DetachRolePolicy",
    "PutRolePolicy", "DeleteRolePolicy", "UpdateAssumeRolePolicy",
    "CreateUser", "DeleteUser", "AttachUserPolicy", "DetachUserPolicy",
    "PutUserPolicy", "DeleteUserPolicy", "CreatePolicy", "DeletePolicy",
    "CreatePolicyVersion", "PutBucketPolicy", "PutBucketAcl",
    "ModifyInstanceAttribute", "CreateSecurityGroup",
    "AuthorizeSecurityGroupIngress", "ModifyVpcAttribute",
)
ARCHIVE_CONFIG_TYPES = (
    "iam.attach_policy", "iam.detach_policy", "iam.config_change", "iam.create_role",
    "iam.delete_role", "iam.create_user", "iam.delete_user",
)
# Request parameters that name the target, in order.
TARGETS = (
    ("roleName", "iam_role"),
    ("userName", "iam_user"),
    ("groupName", "iam_group"),
    ("policyArn", "iam_policy"),
    ("bucketName", "s3_bucket"),
    ("functionName", "lambda_function"),
    ("instanceId", "ec2_instance"),
    ("roleArn", "iam_role"),
)
ARCHIVE_TARGET_IDS = (
    "roleName", "userName", "groupName", "policyArn", "bucketName", "functionName", "instanceId"
)
ARCHIVE_TARGET_NAMES = ("roleName", "userName", "groupName", "policyName", "bucketName", "functionName")
ARCHIVE_TARGET_TYPES = {
    "iam.amazonaws.com": "iam_resource",
    "sts.amazonaws.com": "iam_session",
    "s3.amazonaws.com": "s3_bucket",
    "ec2.amazonaws.com": "ec2_instance",
    "lambda.amazonaws.com": "lambda_function",
    "dynamodb.amazonaws.com": "dynamodb_table",
    "kms.amazonaws.com": "kms_key",
}
AGENT_WORDS = ("agent", "ai", "llm")

# --- readers -----------------------------------------------------------------------


def read_archive(
    spark: SparkSession, path: str, max_files: int | None = None, max_events: int | None = None
) -> DataFrame:
    """Records of all (gzipped) JSON files below a folder.

    ``max_files`` opens the first files by path only, ``max_events`` keeps the first records by
    path and position; both are off by default.
    """
    reader = (
        spark.read.schema(f"Records array<{nested(RECORD)}>")
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
    )
    if max_files is not None:
        first = first_files(spark, path, max_files)
        if not first:
            return spark.createDataFrame([], T.StructType.fromDDL(RECORD))
        path = first
    files = reader.json(path).select(F.col("_metadata.file_path").alias("file"), "Records")
    files = files.where(F.col("file").rlike(r"\.json(\.gz)?$"))
    records = files.select("file", F.posexplode("Records").alias("position", "record"))
    if max_events is not None:
        records = records.orderBy("file", "position").limit(max_events)
    return records.select("record.*")


def file_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """One row: files that gave events and files that gave none (bad or empty)."""
    files = (
        spark.read.schema(f"Records array<{nested(RECORD)}>")
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
        .select(F.col("_metadata.file_path").alias("file"), F.coalesce(F.size("Records"), F.lit(0)).alias("n"))
        .groupBy("file")
        .agg(F.max("n").alias("n"))
    )
    return files.agg(
        F.count_if(F.col("n") > 0).alias("files_processed"), F.count_if(F.col("n") <= 0).alias("files_failed")
    )


def read_dated_archive(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Records of a folder tree ``day=YYYY-MM-DD/``, pruned by day and cut to [start, end]."""
    days = F.col("day").between(F.lit(start[:10]).cast("date"), F.lit(end[:10]).cast("date"))
    records = (
        spark.read.schema(f"Records array<{nested(RECORD)}>, day date")
        .option("multiLine", True)
        .option("basePath", path)
        .json(path)
        .where(days)
        .select(F.inline("Records"))
    )
    return in_range(records, "eventTime", start, end)


def in_range(records: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows whose ISO timestamp lies in the closed range."""
    return records.where(iso_timestamp(F.col(column)).between(as_of_lit(start), as_of_lit(end)))


def parse_lake_rows(rows: DataFrame) -> DataFrame:
    """Flat lake rows (JSON text in two columns) as records, in no order.

    Empty error codes are no error; unreadable JSON counts as empty.
    """
    return rows.select(
        "eventID", "eventTime", "eventName", "eventSource", F.lit("").alias("awsRegion"),
        F.lit(None).cast("boolean").alias("readOnly"),
        F.from_json("userIdentity", IDENTITY).alias("userIdentity"),
        F.coalesce(
            F.from_json("requestParameters", "map<string,string>"),
            F.create_map().cast("map<string,string>"),
        ).alias("requestParameters"),
        F.array().cast("array<struct<ARN:string>>").alias("resources"), "sourceIPAddress", "userAgent",
        F.nullif("errorCode", F.lit("")).alias("errorCode"), "errorMessage",
    )


def parse_lookup_rows(rows: DataFrame) -> DataFrame:
    """Lookup results: the record is JSON text in ``CloudTrailEvent``."""
    return rows.select(F.from_json("CloudTrailEvent", f"{nested(RECORD)}").alias("r")).select("r.*")


def parse_records(rows: DataFrame, column: str = "value") -> DataFrame:
    """One JSON record per row."""
    return rows.select(F.from_json(column, f"{nested(RECORD)}").alias("r")).select("r.*")


# --- normalisation --------------------------------------------------------------------


def _finish(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ACTIVITY_EVENT.fields])


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _payload() -> Column:
    return F.to_json(F.struct(*T.StructType.fromDDL(RECORD).fieldNames()))


def service_event_type(name: Column, service: Column) -> Column:
    return (
        F.when(service == "iam", F.coalesce(fixed_map(IAM_EVENTS)[name], F.lit("iam.config_change")))
        .when(service == "sts", F.coalesce(fixed_map(STS_EVENTS)[name], F.lit("auth.session_start")))
        .when(service == "signin", "auth.login")
        .when(F.startswith(name, F.lit("Create")), "resource.create")
        .when(starts_with_any(name, ("Delete", "Remove")), "resource.delete")
        .when(starts_with_any(name, ("Put", "Update", "Modify")), "resource.modify")
        .when(starts_with_any(name, ("Get", "Describe", "List")), "access.read")
        .otherwise("unknown")
    )


def archive_event_type(name: Column, source: Column) -> Column:
    return (
        F.when(source == "iam.amazonaws.com", F.coalesce(fixed_map(IAM_EVENTS)[name], F.lit("access.admin")))
        .when(source == "sts.amazonaws.com", F.coalesce(fixed_map(STS_EVENTS)[name], F.lit("unknown")))
        .when(source == "signin.amazonaws.com", "auth.login")
        .otherwise(F.coalesce(fixed_map(RESOURCE_EVENTS)[name], F.lit("unknown")))
    )


def normalise_service(records: DataFrame) -> DataFrame:
    """Service profile: read-only noise dropped, actors and targets resolved.

    Rows without a readable time are dropped. The filter on the raw flag comes first.
    """
    name = _blank("eventName")
    service = F.replace(_blank("eventSource"), F.lit(".amazonaws.com"), F.lit(""))
    noise = F.coalesce(F.col("readOnly"), F.lit(False)) & ~service.isin("iam", "sts")
    kind = F.col("userIdentity.type")
    principal = _blank("userIdentity.principalId")
    user = F.coalesce("userIdentity.userName", principal)
    role = _blank("userIdentity.sessionContext.sessionIssuer.userName")
    caller = F.coalesce("userIdentity.invokedBy", F.lit("aws-service"))
    other = F.coalesce(F.nullif(principal, F.lit("")), _blank("userIdentity.arn"))

    def by_kind(root, iam_user, assumed, aws_service, rest) -> Column:
        return (
            F.when(kind == "Root", root).when(kind.isin("IAMUser", "FederatedUser"), iam_user)
            .when(kind == "AssumedRole", assumed).when(kind == "AWSService", aws_service).otherwise(rest)
        )

    params = F.coalesce("requestParameters", F.create_map().cast("map<string,string>"))
    target_id, target_type, target_name = F.lit(""), F.lit(""), F.lit("")
    for key, target in reversed(TARGETS):
        present = F.map_contains_key(params, key)
        value = F.coalesce(F.try_element_at(params, F.lit(key)), F.lit(""))
        shown = F.element_at(F.split(value, "/"), -1) if key.endswith("Arn") else value
        target_id = F.when(present, value).otherwise(target_id)
        target_type = F.when(present, target).otherwise(target_type)
        target_name = F.when(present, shown).otherwise(target_name)
    rows = (
        records.where(~noise)
        .withColumn("timestamp", iso_timestamp(F.col("eventTime")))
        .where(F.col("timestamp").isNotNull())
        .select(
            F.concat(F.lit(f"{SOURCE}/"), _blank("eventID")).alias("id"), F.lit(SOURCE).alias("source"),
            _blank("eventID").alias("source_event_id"), service_event_type(name, service).alias("event_type"),
            F.concat(service, F.lit(":"), name).alias("raw_event_name"), "timestamp",
            by_kind(F.lit("root"), user, F.coalesce(F.nullif(role, F.lit("")), principal), caller, other)
            .alias("actor_id"),
            by_kind(F.lit("Root Account"), user, role, caller, other).alias("actor_display_name"),
            by_kind(
                F.lit("human"), F.lit("human"),
                F.when(contains_any(F.lower(role), AGENT_WORDS), "ai_agent").otherwise("service_account"),
                F.lit("service_account"), F.lit("human"),
            ).alias("actor_type"),
            target_id.alias("target_id"), target_type.alias("target_type"), target_name.alias("target_name"),
            _blank("sourceIPAddress").alias("source_ip"), _blank("userAgent").alias("user_agent"),
            _blank("awsRegion").alias("geo_location"),
            _blank("userIdentity.accessKeyId").alias("session_id"),
            F.col("errorCode").isNull().alias("success"), _blank("errorCode").alias("error_code"),
            _blank("errorMessage").alias("error_message"),
            name.isin(*PRIVILEGED_EVENTS).alias("is_privileged_action"),
            name.isin(*CONFIG_EVENTS).alias("is_config_change"), F.lit(False).alias("is_cross_boundary"),
            _payload().alias("raw_payload"),
        )
    )
    return _finish(rows)


def normalise_archive(records: DataFrame) -> DataFrame:
    """Archive profile: every record kept, read-only ones too.

    An unreadable time gives a NULL timestamp (see :func:`undated`), never the clock.
    """
    name, source = _blank("eventName"), _blank("eventSource")
    user = _blank("userIdentity.userName")
    blank = F.lit("")
    actor = F.coalesce(
        F.nullif(_blank("userIdentity.arn"), blank), F.nullif(user, blank),
        F.col("userIdentity.principalId"), F.lit("unknown"),
    )
    params = F.coalesce("requestParameters", F.create_map().cast("map<string,string>"))

    def first_of(keys, otherwise: Column) -> Column:
        value = otherwise
        for key in reversed(keys):
            value = F.when(
                F.map_contains_key(params, key),
                F.coalesce(F.try_element_at(params, F.lit(key)), F.lit("None")),
            ).otherwise(value)
        return value

    listed = F.col("resources")
    target = F.when(
        F.coalesce(F.size(listed), F.lit(0)) > 0,
        F.coalesce(F.try_element_at(listed, F.lit(1))["ARN"], blank),
    ).otherwise(first_of(ARCHIVE_TARGET_IDS, blank))
    kind = archive_event_type(name, source)
    rows = records.select(
        F.concat(F.lit(f"{SOURCE}/"), _blank("eventID")).alias("id"), F.lit(SOURCE).alias("source"),
        _blank("eventID").alias("source_event_id"), kind.alias("event_type"), name.alias("raw_event_name"),
        iso_timestamp(F.col("eventTime")).alias("timestamp"), actor.alias("actor_id"),
        F.coalesce("userIdentity.userName", actor).alias("actor_display_name"),
        F.when(F.col("userIdentity.type") == "AWSService", "service_account").otherwise("human").alias("actor_type"),
        target.alias("target_id"),
        F.coalesce(fixed_map(ARCHIVE_TARGET_TYPES)[source], F.lit("aws_resource")).alias("target_type"),
        first_of(ARCHIVE_TARGET_NAMES, name).alias("target_name"),
        _blank("sourceIPAddress").alias("source_ip"), _blank("userAgent").alias("user_agent"),
        blank.alias("geo_location"), blank.alias("session_id"),
        F.col("errorCode").isNull().alias("success"), _blank("errorCode").alias("error_code"),
        _blank("errorMessage").alias("error_message"),
        name.isin(*ARCHIVE_PRIVILEGED_EVENTS).alias("is_privileged_action"),
        kind.isin(*ARCHIVE_CONFIG_TYPES).alias("is_config_change"), F.lit(False).alias("is_cross_boundary"),
        _payload().alias("raw_payload"),
    )
    return _finish(rows)


def undated(events: DataFrame) -> DataFrame:
    """Events whose time could not be read."""
    return events.where(F.col("timestamp").isNull())


def normalise(records: DataFrame, profile: str) -> DataFrame:
    """Events by profile name, ``service`` or ``archive``."""
    return {"service": normalise_service, "archive": normalise_archive}[profile](records)
