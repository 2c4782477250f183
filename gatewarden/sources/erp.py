"""ERP tables (employees, roles, role permissions) and the ERP segregation-of-duties audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewarden.functions import fixed_values as fixed
from gatewarden.functions.scalars import as_of_lit, entity_id, fixed_map
from gatewarden.plans.joins import skew_join
from gatewarden.plans.tables import literal_table
from gatewarden.schemas import Estate, empty_table
from gatewarden.sources.canonical import conform

SOURCE = "netsuite"

SCHEMAS = {
    "employee": "id string, email string, firstname string, lastname string, isinactive string, "
    "department string, supervisor string, title string, hiredate string",
    "role": "id string, name string",
    "rolepermissions": "role string, permkey string, permlevel int",
    "employeeroles": "employee_id string, role_id string",
    "subsidiary": "id string, name string",
}

# Modules and their sensitivity.
MODULES = (
    ("AP", "Accounts Payable", "critical"),
    ("AR", "Accounts Receivable", "critical"),
    ("GL", "General Ledger", "critical"),
    ("Payroll", "Payroll", "critical"),
    ("Procurement", "Procurement", "high"),
    ("Setup", "System Setup", "critical"),
    ("Reporting", "Financial Reporting", "high"),
)
AUDIT_MODULES = (
    ("General Ledger", "critical"),
    ("Accounts Payable", "high"),
    ("Accounts Receivable", "high"),
    ("Procurement", "medium"),
    ("Inventory", "medium"),
    ("Fixed Assets", "medium"),
    ("Payroll", "critical"),
    ("Revenue Recognition", "high"),
    ("Treasury", "critical"),
    ("Human Resources", "medium"),
)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """ERP tables landed as Parquet, each in a subfolder of its name."""
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in SCHEMAS.items()}


def read_jdbc_tables(
    spark: SparkSession, url: str, properties: dict[str, str] | None = None,
    slices: dict[str, tuple[str, int, int, int]] | None = None,
) -> dict[str, DataFrame]:
    """The same tables straight from the ERP's database.

    ``slices`` names, per table that should be read by several tasks, a numeric column, its lowest
    and highest value and the number of tasks; other tables are read by one.
    """
    tables = {}
    for name in SCHEMAS:
        column, low, high, tasks = (slices or {}).get(name, (None, None, None, None))
        tables[name] = spark.read.jdbc(
            url, name, column=column, lowerBound=low, upperBound=high, numPartitions=tasks, properties=properties or {}
        )
    return tables


def employees(employee: DataFrame) -> DataFrame:
    eid, blank = F.col("id"), F.lit("")
    full = F.trim(F.concat(F.coalesce("firstname", blank), F.lit(" "), F.coalesce("lastname", blank)))
    return conform(
        employee.select(
            entity_id(SOURCE, F.concat(F.lit("emp:"), eid)).alias("id"), eid.alias("external_id"),
            F.lit(SOURCE).alias("source"), F.lit("human").alias("type"),
            F.coalesce(F.nullif(full, blank), eid).alias("display_name"), "email",
            F.nullif("department", blank).alias("department"),
            F.when(
                F.col("supervisor") != "",
                entity_id(SOURCE, F.concat(F.lit("emp:"), F.col("supervisor"))),
            ).alias("manager_id"),
            F.when(F.col("isinactive").isin("T", "True", "true", "t"), "inactive").otherwise("active").alias("status"),
            F.to_json(F.struct(eid.alias("netsuite_id"), "title", F.col("hiredate").alias("hire_date"))).alias(
                "attributes"
            ),
        ),
        "subject",
    )


def roles(role: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Roles with their keys as actions.

    The sets hold each key and level of the ERP's catalogue at most once, however
    many rows a role has.
    """
    key, level = F.col("permkey"), F.coalesce("permlevel", F.lit(0))
    names = fixed_map({str(n): v for n, v in fixed.ERP_LEVELS.items()})
    action = F.concat(
        F.lit("netsuite:"), key, F.lit("."), F.coalesce(names[level.cast("string")], F.lit("unknown"))
    )
    financial, admin = key.isin(*fixed.ERP_FINANCIAL_KEYS), key.isin(*fixed.ERP_ADMIN_KEYS)
    words = F.array_compact(F.array(F.when(financial, key), F.when(admin, F.lit("admin"))))
    gathered = role_permissions.groupBy(F.col("role").alias("id")).agg(
        F.array_sort(F.collect_set(action)).alias("actions"),
        F.array_sort(F.collect_set(key)).alias("permission_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(words)))).alias("risk_keywords"),
        F.bool_or((financial & (level >= 2)) | admin).alias("is_privileged"),
    )
    empty = F.array().cast("array<string>")
    rid = F.col("id")
    return conform(
        role.join(gathered, "id", "left").select(
            entity_id(SOURCE, F.concat(F.lit("role:"), rid)).alias("id"), F.lit(SOURCE).alias("source"),
            F.coalesce("name", F.concat(F.lit("Role-"), rid)).alias("name"), F.lit("role").alias("type"),
            F.coalesce("actions", empty).alias("actions"),
            F.coalesce("is_privileged", F.lit(False)).alias("is_privileged"),
            F.coalesce("risk_keywords", empty).alias("risk_keywords"),
            F.coalesce("permission_keys", empty).alias("permission_keys"),
            F.to_json(F.struct(rid.alias("netsuite_role_id"))).alias("attributes"),
        ),
        "permission",
    )


def role_grants(employee_roles: DataFrame, role: DataFrame) -> DataFrame:
    """Assignments; unknown roles drop out."""
    known = skew_join(employee_roles, role.select(F.col("id").alias("role_id")), "role_id", "left_semi")
    return conform(
        known.select(
            entity_id(SOURCE, F.concat(F.lit("emp:"), F.col("employee_id"))).alias("subject_id"),
            entity_id(SOURCE, F.concat(F.lit("role:"), F.col("role_id"))).alias("permission_id"),
        ).select(
            F.concat_ws("/", "subject_id", "permission_id").alias("id"), "subject_id", "permission_id",
            F.lit(SOURCE).alias("source"), F.lit(True).alias("is_active"), F.lit(SOURCE).alias("granted_by"),
        ),
        "assignment",
    )


def module_resources(spark: SparkSession) -> DataFrame:
    table = literal_table(spark, "code string, name string, sensitivity string", MODULES)
    return conform(
        table.select(
            entity_id(SOURCE, F.concat(F.lit("module:"), F.col("code"))).alias("id"), F.lit(SOURCE).alias("source"),
            F.lit("netsuite_module").alias("type"), "name", "sensitivity",
        ),
        "resource",
    )


def subsidiaries(subsidiary: DataFrame) -> DataFrame:
    return conform(
        subsidiary.select(
            entity_id(SOURCE, F.concat(F.lit("subsidiary:"), F.col("id"))).alias("id"),
            F.lit(SOURCE).alias("source"), F.lit("netsuite_subsidiary").alias("type"),
            F.coalesce("name", F.lit("")).alias("name"), F.lit("high").alias("sensitivity"),
            F.to_json(F.struct(F.col("id").alias("netsuite_id"))).alias("attributes"),
        ),
        "resource",
    )


def erp_estate(tables: dict[str, DataFrame]) -> Estate:
    """Canonical tables of one ERP."""
    spark = tables["employee"].sparkSession
    return Estate(
        subject=employees(tables["employee"]),
        permission=roles(tables["role"], tables["rolepermissions"]),
        resource=subsidiaries(tables["subsidiary"]).unionByName(module_resources(spark)),
        assignment=role_grants(tables["employeeroles"], tables["role"]),
        escalation_path=empty_table(spark, "escalation_path"),
        event=empty_table(spark, "event"),
    )


# --- segregation-of-duties audit document --------------------------------------------

AUDIT = (
    "employees array<string>, roles array<string>, "
    "sod_rules map<string,struct<violating_users:array<string>,user_roles:array<struct<name:string,role:string>>>>"
)
# Audit rule key -> rule id, both actions, risk, control, severity, confidence.
AUDIT_RULES = (
    ("JE_create_approve", "SOD-NS-R1-JE-APPROVE", "Make Journal Entry", "Journal Approval",
     "Can create and self-approve journal entries — GL manipulation risk", "ITGC-GL-01", "critical", 0.97),
    ("vendor_pay", "SOD-NS-R2-VENDOR-PAY", "Vendors", "Pay Bills",
     "Can create fake vendors and issue unauthorized payments", "ITGC-AP-03", "critical", 0.98),
    ("creditmemo_payment", "SOD-NS-R3-CREDITMEMO-PAY", "Credit Memo", "Customer Payment",
     "Can issue credit memos and process payments — unauthorized refund risk", "ITGC-AR-02", "high", 0.93),
    ("customer_creditmemo", "SOD-NS-R4-CUSTOMER-CREDITMEMO", "Customers", "Credit Memo",
     "Can create fictitious customers and issue credit memos", "ITGC-AR-01", "high", 0.92),
    ("customer_refund", "SOD-NS-R5-CUSTOMER-REFUND", "Customers", "Customer Refund",
     "Can create fictitious customers and issue refunds", "ITGC-AR-03", "high", 0.91),
    ("invoice_payment", "SOD-NS-R6-INVOICE-DEPOSIT", "Invoice", "Customer Deposit",
     "Can create invoices and receive deposits — revenue fraud risk", "ITGC-REV-01", "medium", 0.85),
)
AUDIT_RULE_COLUMNS = (
    "rule_key string, rule_id string, action_a string, action_b string, risk string, control string, "
    "severity string, confidence double"
)
# Department patterns, in order of precedence.
DEPARTMENT_PATTERNS = (
    ("Controller", "Accounting"),
    ("Revenue", "Revenue Accounting"),
    ("AP", "Accounts Payable"),
    ("Cash App", "Accounts Payable"),
    ("Credit", "Credit & Collections"),
    ("Shared Services", "Shared Services"),
    ("Fixed Assets", "Fixed Assets"),
    ("Human Resources", "Human Resources"),
    ("Production", "Operations"),
    ("Buyer", "Procurement"),
    ("Inventory", "Inventory"),
    ("EFT", "Treasury"),
    ("VP", "Executive"),
    ("Director", "Management"),
    ("Celigo", "Integrations"),
    ("Messenger", "IT"),
)
DEFAULT_DEPARTMENT = "Finance"
# Role-name words -> actions, keywords; the first match decides. A plus asks for both.
ROLE_BUNDLES = (
    (("controller", "director", "vp"),
     ("Make Journal Entry", "Journal Approval", "Vendors", "Pay Bills", "Credit Memo"),
     ("financial_admin", "journal_approval")),
    (("ap", "cash app"), ("Vendors", "Pay Bills", "Check", "Vendor Bill"), ("accounts_payable",)),
    (("maintenance and invoicing", "maint"), ("Invoice", "Credit Memo", "Customers", "Customer Payment"),
     ("invoicing", "credit_memo")),
    (("revenue",), ("Invoice", "Credit Memo", "Customers", "Revenue Recognition"), ("revenue",)),
    (("credit+collections",), ("Credit Memo", "Customers", "Customer Refund", "Customer Payment"),
     ("credit_collections",)),
    (("shared services",), ("Vendors", "Customer Refund", "Credit Memo", "Customers"), ("shared_services",)),
    (("eft",), ("Pay Bills", "Check", "Vendor Payment"), ("electronic_funds_transfer",)),
    (("buyer", "procurement"), ("Purchase Order", "Vendors"), ("procurement",)),
    (("fixed assets",), ("Make Journal Entry", "Fixed Assets"), ("fixed_assets",)),
    (("human resources",), ("Employee Record", "Payroll"), ("hr",)),
)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit documents (one row per file)."""
    return spark.read.schema(AUDIT).option("multiLine", True).json(path)


def audit_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """employee(name), role(name), employee_role(name, role, role_pos), violator(rule_key, name, pos, roles).

    ``role_pos`` is the place of the first mention of the role for the employee.
    """
    # Documents are told apart by their content.
    rules = documents.select(
        F.xxhash64(F.to_json("sod_rules")).alias("document"), F.posexplode(F.map_entries("sod_rules")).alias("rule_pos", "rule")
    )
    mentions = rules.select("rule_pos", F.posexplode("rule.value.user_roles").alias("pos", "entry")).select(
        F.col("entry.name").alias("name"), F.col("entry.role").alias("role"),
        F.struct("rule_pos", "pos").alias("place"),
    )
    # A person's roles under one rule, in the order of their mention: a handful, met by a join.
    held = (
        rules.select("document", "rule_pos", F.posexplode("rule.value.user_roles").alias("pos", "entry"))
        .groupBy("document", "rule_pos", F.col("entry.name").alias("name"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("entry.role").alias("role")))).alias("mentioned"))
    )
    violators = (
        rules.select(
            "document", "rule_pos", F.col("rule.key").alias("rule_key"),
            F.posexplode("rule.value.violating_users").alias("pos", "name"),
        )
        .join(held, ["document", "rule_pos", "name"], "left")
        .select(
            "rule_key", "pos", "name",
            F.coalesce(F.transform("mentioned", lambda m: m["role"]), F.array().cast("array<string>")).alias("roles"),
        )
    )
    return {
        "employee": documents.select(F.explode("employees").alias("name")).distinct(),
        "role": documents.select(F.explode("roles").alias("name")).distinct(),
        "employee_role": mentions.groupBy("name", "role").agg(F.min("place").alias("role_pos")),
        "violator": violators,
    }


def infer_departments(employee_role: DataFrame) -> DataFrame:
    """(name, department): first pattern found in the employee's first matching role.

    ``employee_role``: name, role, role_pos (orderable).
    """
    text = F.lower("role")
    place, department = F.lit(None).cast("int"), F.lit(None).cast("string")
    for position, (pattern, value) in reversed(list(enumerate(DEPARTMENT_PATTERNS))):
        found = F.contains(text, F.lit(pattern.lower()))
        place = F.when(found, position).otherwise(place)
        department = F.when(found, value).otherwise(department)
    marked = employee_role.withColumn("place", place).withColumn("found", department)
    order = F.when(F.col("place").isNotNull(), F.struct("role_pos", "place"))
    return marked.groupBy("name").agg(
        F.coalesce(F.min_by("found", order), F.lit(DEFAULT_DEPARTMENT)).alias("department")
    )


def role_bundle(name: Column) -> Column:
    """Struct (actions, risk_keywords, is_privileged) a role name stands for."""
    text = F.lower(name)

    def words(values) -> Column:
        return F.array(*[F.lit(v) for v in values])

    bundle = F.struct(
        words(("View",)).alias("actions"), F.array().cast("array<string>").alias("risk_keywords"),
        F.lit(False).alias("is_privileged"),
    )
    for position, (patterns, actions, keywords) in reversed(list(enumerate(ROLE_BUNDLES))):
        hit = F.lit(False)
        for pattern in patterns:
            both = F.lit(True)
            for part in pattern.split("+"):
                both = both & F.contains(text, F.lit(part))
            hit = hit | both
        bundle = F.when(
            hit,
            F.struct(
                words(actions).alias("actions"), words(keywords).alias("risk_keywords"),
                F.lit(position == 0).alias("is_privileged"),
            ),
        ).otherwise(bundle)
    return bundle


def audit_roles(role: DataFrame) -> DataFrame:
    return conform(
        role.withColumn("bundle", role_bundle(F.col("name"))).select(
            entity_id(SOURCE, F.concat(F.lit("role:"), F.col("name"))).alias("id"),
            F.lit(SOURCE).alias("source"), "name", F.lit("role").alias("type"), "bundle.actions",
            "bundle.is_privileged", "bundle.risk_keywords",
        ),
        "permission",
    )


def audit_findings(violator: DataFrame, employee: DataFrame) -> DataFrame:
    """Escalation-path rows, one per rule and violating employee that is listed."""
    spark = violator.sparkSession
    rules = literal_table(spark, AUDIT_RULE_COLUMNS, AUDIT_RULES)
    known = skew_join(violator, employee.select("name").distinct(), "name", "left_semi")
    rows = skew_join(known, rules, "rule_key")
    first = F.concat(
        F.lit("Has '"), F.col("action_a"), F.lit("' via role(s): "),
        F.array_join(F.slice(F.coalesce("roles", F.array().cast("array<string>")), 1, 2), ", "),
    )
    second = F.concat(F.lit("Also has '"), F.col("action_b"), F.lit("' — SoD conflict"))
    erp = F.lit("NetSuite ERP")
    return conform(
        rows.select(
            F.concat_ws("/", "rule_id", "name").alias("id"),
            entity_id(SOURCE, F.concat(F.lit("employee:"), F.col("name"))).alias("subject_id"),
            F.array(
                F.struct(F.col("action_a").alias("action"), erp.alias("resource"), first.alias("description")),
                F.struct(F.col("action_b").alias("action"), erp.alias("resource"), second.alias("description")),
            ).alias("steps"),
            F.col("risk").alias("end_result"), "confidence", F.lit(SOURCE).alias("source"),
        ),
        "escalation_path",
    )


def audit_module_resources(spark: SparkSession) -> DataFrame:
    table = literal_table(spark, "name string, sensitivity string", AUDIT_MODULES)
    return conform(
        table.select(
            entity_id(SOURCE, F.concat(F.lit("module:"), F.col("name"))).alias("id"), F.lit(SOURCE).alias("source"),
            F.lit("netsuite_module").alias("type"), "name", "sensitivity",
        ),
        "resource",
    )


def audit_estate(documents: DataFrame, as_of: str) -> Estate:
    """Canonical tables of audit documents.

    The documents say nothing about logins, MFA or grant dates: those stay NULL, and
    creation is taken as ``as_of``.
    """
    tables = audit_tables(documents)
    spark = documents.sparkSession
    name = F.col("name")
    dotted = F.replace(F.lower(name), F.lit(" "), F.lit("."))
    people = tables["employee"].join(infer_departments(tables["employee_role"]), "name", "left")
    subject = conform(
        people.select(
            entity_id(SOURCE, F.concat(F.lit("employee:"), name)).alias("id"), dotted.alias("external_id"),
            F.lit(SOURCE).alias("source"), F.lit("human").alias("type"), name.alias("display_name"),
            F.concat(dotted, F.lit("@company.com")).alias("email"),
            F.coalesce("department", F.lit(DEFAULT_DEPARTMENT)).alias("department"),
            F.lit("active").alias("status"), as_of_lit(as_of).alias("created_at"),
        ),
        "subject",
    )
    listed = skew_join(
        tables["employee_role"], tables["role"].select(F.col("name").alias("role")), "role", "left_semi"
    ).join(tables["employee"], "name", "left_semi")
    grants = conform(
        listed.select(
            entity_id(SOURCE, F.concat(F.lit("employee:"), name)).alias("subject_id"),
            entity_id(SOURCE, F.concat(F.lit("role:"), F.col("role"))).alias("permission_id"),
        ).select(
            F.concat_ws("/", "subject_id", "permission_id").alias("id"), "subject_id", "permission_id",
            F.lit(SOURCE).alias("source"), F.lit(True).alias("is_active"),
        ),
        "assignment",
    )
    return Estate(
        subject=subject,
        permission=audit_roles(tables["role"]),
        resource=audit_module_resources(spark),
        assignment=grants,
        escalation_path=audit_findings(tables["violator"], tables["employee"]),
        event=empty_table(spark, "event"),
    )
