"""Bind the star-schema test tables to the canonical identity tables.

Customers become subjects, parts permissions, suppliers resources, order lines
assignments, and the event stream activity events. The same formulas are
restated in SQL for the oracle (``verification.binding_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewarden.schemas import Estate

AS_OF = "2002-01-01 00:00:00"
EVENT_AS_OF = "2024-01-31 00:00:00"
DRIFT_AS_OF = "2001-08-02 00:00:00"
# Events whose action starts with this stand for access reviews.
REVIEW_PREFIX = "svc0:"

SOURCE_NAMES = ("aws_iam", "okta", "entra", "netsuite", "healthcare")
FIRST_ACTIONS = (
    "iam:CreateRole", "iam:AttachRolePolicy", "sts:AssumeRole", "iam:PassRole",
    "lambda:CreateFunction", "ec2:RunInstances", "iam:CreateAccessKey", "iam:*",
    "netsuite:TRAN_PURCHORD.full", "netsuite:TRAN_VENDPYMT.full", "netsuite:LIST_VENDOR.edit",
    "netsuite:TRAN_VENDBILL.full", "netsuite:TRAN_JOURNAL.full", "netsuite:ADMI_ACCTPERIODS.full",
)
EVENT_TYPES = {
    "signup": "iam.create_user",
    "click": "access.read",
    "view": "access.list",
    "purchase": "access.write",
    "error": "auth.login",
}


# Stated, so that opening a table needs no job to look at file footers.
FILE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _text(column: Column) -> Column:
    return column.cast("string")


def _div(column: Column, n: int) -> Column:
    return F.floor(column / n).cast("bigint")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order's customer and date."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    activity = lines(spark, sf_dir).groupBy("o_custkey").agg(
        F.max("l_shipdate").alias("last_ship"), F.min("o_orderdate").alias("first_order")
    )
    k = F.col("c_custkey")
    kind = (
        F.when(k % 20 == 0, "service_account")
        .when(k % 20 == 1, "ai_agent")
        .when(k % 20 == 2, "group")
        .otherwise("human")
    )
    is_cloud = F.col("n_regionkey") == 0
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(activity, k == F.col("o_custkey"), "left")
        .select(
            F.concat(F.lit("S"), _text(k)).alias("id"),
            F.concat(F.lit("S"), _text(k)).alias("external_id"),
            _pick(SOURCE_NAMES, F.col("n_regionkey")).alias("source"),
            kind.alias("type"),
            F.when(k % 4 == 0, F.concat(F.lit("Name "), _text(_div(k, 6))))
            .otherwise(F.col("c_name")).alias("display_name"),
            F.when(k % 5 != 0, F.concat(F.lit("U"), _text(_div(k, 2)), F.lit("@Corp.test ")))
            .alias("email"),
            F.when((k % 20 != 2) & (k % 13 != 0), F.col("c_mktsegment")).alias("department"),
            F.when(k == 0, None)
            .when(k == 7, "S70")
            .when(k % 97 == 5, "S999999999")
            .otherwise(F.concat(F.lit("S"), _text(_div(k, 10)))).alias("manager_id"),
            F.when(k % 17 == 0, "deleted")
            .when((k % 17).isin(1, 2), "inactive")
            .when(k % 17 == 3, "suspended")
            .otherwise("active").alias("status"),
            F.when(k % 3 != 0, F.col("last_ship")).alias("last_seen"),
            F.when((k % 20).isin(1, 2) | (k % 7 == 0), None)
            .otherwise(F.col("c_acctbal") >= 1000).alias("mfa_enabled"),
            F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("attributes"),
            F.when(is_cloud, k % 40 == 0).alias("trust_policy_open"),
            F.when(is_cloud, k % 30 == 0).alias("cross_account_trust"),
            F.when(is_cloud, k % 60 == 0).alias("cross_account_no_conditions"),
            F.when(is_cloud & (k % 30 == 0), F.array(F.lpad(_text(k), 12, "0")))
            .alias("cross_account_ids"),
            F.col("first_order").alias("created_at"),
            F.col("first_order").alias("updated_at"),
            k.alias("ingest_seq"),
        )
    )


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size")
    ordinary = [
        F.concat(
            F.lit("svc"), _text(size % 7), F.lit(":Op"),
            _text((p if pos == 0 else p * 3 + pos * 7) % 60),
        )
        for pos in range(3)
    ]
    first = F.when(p % 150 < len(FIRST_ACTIONS), F.try_element_at(
        F.array(*[F.lit(a) for a in FIRST_ACTIONS]), (p % 150 + 1).cast("int")
    )).otherwise(ordinary[0])
    key = F.split_part(F.split_part(first, F.lit(":"), F.lit(2)), F.lit("."), F.lit(1))
    by_arn = F.concat(F.lit("arn:res:"), _text(p % 97))
    by_name = F.concat(F.lit("Supplier#"), F.lpad(_text(p % 89), 9, "0"))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), _text(p)).alias("id"),
        _pick(SOURCE_NAMES, p % 5).alias("source"),
        F.when(p % 50 == 0, F.concat(F.lit("Break-Glass "), _text(p)))
        .when(p % 50 == 1, F.concat(F.lit("Admin "), _text(p)))
        .otherwise(F.concat(F.col("p_name"), F.lit(" "), _text(p))).alias("name"),
        F.when(p % 25 == 1, "group").when(p % 25 < 10, "role").otherwise("policy").alias("type"),
        F.array(first, ordinary[1], ordinary[2]).alias("actions"),
        F.when(p % 8 == 0, F.array(by_arn, F.concat(F.lit("Supplier#"), F.lpad(_text(p % 97), 9, "0"))))
        .when(p % 8 == 4, F.array(by_arn))
        .when(p % 4 == 1, F.array(by_name))
        .when(p % 4 == 2, F.array(F.lit("*")))
        .otherwise(none).alias("resources"),
        ((size >= 45) | (p % 50).isin(0, 1)).alias("is_privileged"),
        F.when(p % 50 == 1, F.array(F.lit("admin"))).otherwise(none).alias("risk_keywords"),
        F.when((p % 150 >= 8) & (p % 150 <= 13), F.array(key)).otherwise(none).alias("permission_keys"),
        F.when(p % 50 == 3, F.array(F.lit("env:prod"), F.lit("SOS-Admin"))).otherwise(none).alias("tags"),
        F.lit("{}").alias("attributes"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("R"), _text(s)).alias("id"),
        _pick(SOURCE_NAMES, s % 5).alias("source"),
        F.lit("supplier").alias("type"),
        F.col("s_name").alias("name"),
        F.when(s % 10 == 0, "critical")
        .when((s % 10).isin(1, 2), "high")
        .when((s % 10).isin(3, 4, 5), "medium")
        .otherwise("low").alias("sensitivity"),
        F.concat(F.lit("arn:res:"), _text(s)).alias("arn"),
        F.lit("{}").alias("attributes"),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return lines(spark, sf_dir).select(
        F.concat(
            F.lit("A"), _text(F.col("l_orderkey")), F.lit("-"), _text(n), F.lit("-"),
            _text(F.col("l_partkey")), F.lit("-"), _text(F.col("l_suppkey")),
        ).alias("id"),
        F.concat(F.lit("S"), _text(F.col("o_custkey"))).alias("subject_id"),
        F.concat(F.lit("P"), _text(F.col("l_partkey"))).alias("permission_id"),
        F.when((n == 1) & (F.col("l_quantity") <= 5),
               F.concat(F.lit("R"), _text(F.col("l_suppkey")))).alias("resource_id"),
        F.lit("bound").alias("source"),
        F.col("o_orderdate").alias("granted_at"),
        F.when(n == 1, "okta").when(n == 2, "admin@corp.test").when(n == 3, "auto-prov")
        .when(n == 4, "system").alias("granted_by"),
        F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("last_used"),
        (F.col("l_linestatus") == "O").alias("is_active"),
        F.when(n == 4, "ticket").alias("justification"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])[F.col("event_type")]
    blank = F.lit("")
    return table(spark, sf_dir, "events").select(
        _text(e).alias("id"),
        F.lit("bound").alias("source"),
        _text(e).alias("source_event_id"),
        kind.alias("event_type"),
        F.concat(F.lit("svc"), _text(e % 7), F.lit(":Op"), _text(e % 60)).alias("raw_event_name"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("S"), _text(F.col("user_id"))).alias("actor_id"),
        blank.alias("actor_display_name"),
        F.lit("human").alias("actor_type"),
        blank.alias("target_id"),
        blank.alias("target_type"),
        blank.alias("target_name"),
        F.concat(F.lit("10.0.0."), F.get_json_object("props", "$.k")).alias("source_ip"),
        blank.alias("user_agent"),
        blank.alias("geo_location"),
        blank.alias("session_id"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", "FAILURE").otherwise("").alias("error_code"),
        blank.alias("error_message"),
        F.lit(False).alias("is_privileged_action"),
        F.lit(False).alias("is_config_change"),
        F.lit(False).alias("is_cross_boundary"),
        F.col("props").alias("raw_payload"),
    )


def estate(spark: SparkSession, sf_dir: str) -> Estate:
    """All canonical tables over one test-data folder; nothing runs or is planned yet."""
    from gatewarden.operators.escalation import detect_escalation_paths

    def paths() -> DataFrame:
        owners = bound.subject.select(F.col("id").alias("subject_id"), F.col("source").alias("owner"))
        found = detect_escalation_paths(bound).drop("source").join(owners, "subject_id")
        return found.select(
            "id", "subject_id", "steps", "end_result", "confidence", F.col("owner").alias("source")
        )

    bound = Estate(
        subject=lambda: subjects(spark, sf_dir),
        permission=lambda: permissions(spark, sf_dir),
        resource=lambda: resources(spark, sf_dir),
        assignment=lambda: assignments(spark, sf_dir),
        event=lambda: events(spark, sf_dir),
        escalation_path=paths,
    )
    return bound
