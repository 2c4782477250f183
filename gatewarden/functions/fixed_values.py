"""Word lists, lookup tables and constants the results depend on.

They are stated as plain text because labels, flags and scores must come out
the same for every build of these rules.
"""

# --- sources ---------------------------------------------------------------
ERP_SOURCES = ("netsuite", "sap", "oracle_erp")
CLOUD_SOURCES = ("aws_iam", "entra", "okta")
GRANTING_SYSTEMS = ("aws_iam", "okta", "entra", "netsuite")

# --- cloud actions ----------------------------------------------------------
HIGH_RISK_ACTIONS = (
    "iam:CreateRole",
    "iam:AttachRolePolicy",
    "iam:PutRolePolicy",
    "iam:CreateUser",
    "iam:AttachUserPolicy",
    "iam:PutUserPolicy",
    "iam:PassRole",
    "iam:CreateAccessKey",
    "iam:UpdateAssumeRolePolicy",
    "sts:AssumeRole",
    "iam:AddUserToGroup",
    "iam:CreatePolicy",
    "iam:CreatePolicyVersion",
    "lambda:CreateFunction",
    "lambda:UpdateFunctionCode",
    "lambda:InvokeFunction",
    "lambda:AddPermission",
    "s3:PutBucketPolicy",
    "s3:DeleteBucket",
    "ec2:RunInstances",
    "ec2:ModifyInstanceAttribute",
    "secretsmanager:GetSecretValue",
    "kms:Decrypt",
    "organizations:*",
    "iam:*",
    "sts:*",
)
# Services whose every action counts as privileged in account exports.
PRIVILEGED_SERVICES = ("iam:", "sts:", "organizations:")

# The policy-directory reader uses a slightly shorter list.
DIRECTORY_HIGH_RISK_ACTIONS = tuple(
    a
    for a in HIGH_RISK_ACTIONS
    if a not in ("lambda:AddPermission", "ec2:ModifyInstanceAttribute", "organizations:*")
)

RISK_VERBS = (
    "Create", "Delete", "Attach", "Put", "PassRole", "Admin",
    "Update", "Remove", "Modify", "Invoke", "Decrypt",
)

# Escalation patterns: (name, actions, confidence, end result).
ESCALATION_PATTERNS = (
    ("CreateRole + AttachRolePolicy + AssumeRole",
     ("iam:CreateRole", "iam:AttachRolePolicy", "sts:AssumeRole"), 0.99,
     "Can create an IAM role, attach an admin policy, and assume it"),
    ("CreateRole + PutRolePolicy + AssumeRole",
     ("iam:CreateRole", "iam:PutRolePolicy", "sts:AssumeRole"), 0.99,
     "Can create an IAM role with inline admin policy and assume it"),
    ("CreateUser + AttachUserPolicy",
     ("iam:CreateUser", "iam:AttachUserPolicy"), 0.90,
     "Can create a new IAM user with arbitrary policies"),
    ("PassRole + Lambda",
     ("iam:PassRole", "lambda:CreateFunction"), 0.85,
     "Can pass a high-privilege role to a new Lambda function"),
    ("PassRole + EC2",
     ("iam:PassRole", "ec2:RunInstances"), 0.85,
     "Can launch EC2 with a high-privilege instance profile"),
    ("CreateAccessKey for other users",
     ("iam:CreateAccessKey",), 0.80,
     "Can create access keys for other IAM users"),
    ("UpdateAssumeRolePolicy",
     ("iam:UpdateAssumeRolePolicy",), 0.75,
     "Can modify role trust policies to allow self-assumption"),
)
# Strict variant, used with policy directories: no wildcard coverage.
STRICT_ESCALATION_PATTERNS = (
    ("CreateRole + AttachRolePolicy + AssumeRole",
     ("iam:CreateRole", "iam:AttachRolePolicy", "sts:AssumeRole"), 0.99,
     "Can create an IAM role, attach an admin policy, and assume it"),
    ("CreateRole + PutRolePolicy + AssumeRole",
     ("iam:CreateRole", "iam:PutRolePolicy", "sts:AssumeRole"), 0.99,
     "Can create an IAM role with inline admin policy and assume it"),
    ("CreateUser + AttachUserPolicy",
     ("iam:CreateUser", "iam:AttachUserPolicy"), 0.90,
     "Can create a new IAM user with arbitrary policies"),
    ("PassRole + Lambda",
     ("iam:PassRole", "lambda:CreateFunction"), 0.95,
     "Can pass a high-privilege role to a Lambda and execute it"),
    ("PassRole + EC2",
     ("iam:PassRole", "ec2:RunInstances"), 0.90,
     "Can pass a high-privilege role to an EC2 instance"),
    ("CreateAccessKey for other users",
     ("iam:CreateAccessKey",), 0.80,
     "Can create access keys for other IAM users (credential theft)"),
    ("UpdateAssumeRolePolicy + AssumeRole",
     ("iam:UpdateAssumeRolePolicy", "sts:AssumeRole"), 0.95,
     "Can modify trust policy of existing role and assume it"),
)

CONFIG_ACTIONS = (
    "iam:UpdateAssumeRolePolicy",
    "iam:PutRolePolicy",
    "iam:PutUserPolicy",
    "iam:AttachRolePolicy",
    "iam:AttachUserPolicy",
    "iam:CreatePolicyVersion",
)

# --- ERP keys ---------------------------------------------------------------
ERP_FINANCIAL_KEYS = (
    "TRAN_PURCHORD",
    "TRAN_VENDBILL",
    "TRAN_VENDPYMT",
    "TRAN_INVOICE",
    "TRAN_CUSTPYMT",
    "TRAN_JOURNAL",
    "TRAN_PAYROLL",
    "LIST_VENDOR",
    "LIST_CUSTJOB",
    "LIST_ACCOUNT",
    "ADMI_SETUP",
    "ADMI_ACCTPERIODS",
    "REPT_FINANCIALS",
)
ERP_ADMIN_KEYS = ("ADMI_SETUP", "ADMI_ACCTPERIODS")
ERP_SOD_PAIRS = (
    ("TRAN_PURCHORD", "TRAN_VENDPYMT"),
    ("LIST_VENDOR", "TRAN_VENDBILL"),
    ("TRAN_VENDBILL", "TRAN_VENDPYMT"),
    ("TRAN_JOURNAL", "ADMI_ACCTPERIODS"),
    ("TRAN_CUSTPYMT", "TRAN_INVOICE"),
    ("LIST_ACCOUNT", "TRAN_JOURNAL"),
)
ERP_LEVELS = {0: "none", 1: "view", 2: "create", 3: "edit", 4: "full"}

# --- rule word lists --------------------------------------------------------
BREAK_GLASS_REGEX = r"(?i)(emergency|break[-_]?glass|firecall|elevated[-_]?access|sos[-_]?admin)"
SECURITY_WORDS = ("securityaudit", "security", "iam", "guardduty", "securityhub", "waf")
FINANCIAL_WORDS = ("finance", "accounting", "payroll", "treasury", "billing", "ap", "ar", "gl")
IDENTITY_WORDS = ("user", "directory", "group")
INFRASTRUCTURE_WORDS = ("infra", "ec2", "compute", "network")
ADMIN_GROUP_WORDS = ("admin", "super", "owner", "root", "devops", "sre", "platform")

# --- codes of the flat vector -----------------------------------------------
TYPE_CODES = {"human": 0.0, "service_account": 1.0, "ai_agent": 2.0, "group": 3.0}
STATUS_CODES = {"active": 0.0, "inactive": 1.0, "suspended": 2.0, "deleted": 3.0}

# --- violation classes: class -> (model id, report name) --------------------
MODEL_IDS = {
    1: "SOX-01", 2: "SOX-02", 3: "ZT-01", 4: "ZT-02",
    5: "ZT-03", 6: "ZT-04", 7: "ZT-05", 8: "ZT-06",
    9: "CB-01", 10: "ZT-07", 11: "SOX-03", 12: "SOX-04",
    13: "SOX-05", 14: "SOX-06", 15: "CB-02",
}
VIOLATION_NAMES = {
    1: "SoD Violation",
    2: "Privilege Escalation",
    3: "Excessive Privilege",
    4: "Stale / Dormant Account",
    5: "Orphan Account",
    6: "Permission Creep",
    7: "Open Trust Policy",
    8: "Missing MFA",
    9: "Cross-System Inconsistency",
    10: "Service Account Misuse",
    11: "Unauthorized Config Change",
    12: "Access Without Justification",
    13: "Toxic Role Combination",
    14: "Break-Glass Abuse",
    15: "Cross-Boundary Bypass",
}

# --- policy vocabulary -------------------------------------------------------
POLICY_OPERATORS = ("gt", "lt", "gte", "lte", "eq", "neq", "in", "not_in")
SEVERITIES = ("critical", "high", "medium", "low")

# Best-practice templates:
# (name, category, action, severity, base confidence, conditions).
POLICY_TEMPLATES = (
    ("Dormant privileged access — 90 day threshold",
     "zero_trust", "flag_for_review", "high", 0.85,
     (("days_since_last_activity", "gt", 90),
      ("privileged_permissions", "gt", 0),
      ("type", "eq", "human"))),
    ("Missing MFA on privileged human accounts",
     "zero_trust", "require_mfa", "critical", 0.95,
     (("mfa_usage_rate", "lt", 0.01),
      ("privileged_permissions", "gt", 0),
      ("type", "eq", "human"))),
    ("Excessive privilege — 3x peer median",
     "zero_trust", "flag_for_review", "high", 0.75,
     (("permission_to_peer_median_ratio", "gt", 3.0),
      ("total_permissions", "gt", 5))),
    ("Service account with high IP diversity",
     "anomaly", "alert", "medium", 0.65,
     (("type", "eq", "service_account"),
      ("distinct_source_ips_30d", "gt", 10))),
    ("AI agent permission growth",
     "agent_governance", "flag_for_review", "high", 0.80,
     (("type", "eq", "ai_agent"),
      ("permissions_added_30d", "gt", 3),
      ("permissions_removed_30d", "eq", 0))),
    ("Cross-boundary financial access",
     "cross_boundary", "escalate", "critical", 0.85,
     (("source_system_count", "gte", 2),
      ("privileged_permissions", "gt", 0),
      ("sod_pair_membership_count", "gt", 0))),
    ("Open trust policy — Principal:*",
     "zero_trust", "alert", "critical", 0.95,
     (("type", "in", ["service_account", "ai_agent"]),
      ("trust_policy_open", "eq", True))),
    ("Access granted without justification — privileged",
     "sox_compliance", "request_justification", "medium", 0.60,
     (("has_business_justification", "eq", False),
      ("privileged_permissions", "gt", 0))),
    ("High graph centrality identity",
     "anomaly", "flag_for_review", "high", 0.70,
     (("betweenness_centrality", "gt", 0.15),
      ("type", "eq", "human"))),
    ("Orphaned cross-system identity",
     "zero_trust", "alert", "high", 0.85,
     (("cross_system_consistency_score", "lt", 0.5),
      ("source_system_count", "gte", 2))),
)
