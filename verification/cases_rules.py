"""The labelling rules, one query each, and their union."""

from pyspark.sql import functions as F

from gatewarden import bind
from gatewarden.functions.fixed_values import ESCALATION_PATTERNS
from gatewarden.operators import access, behaviour, drift, features, labels, peers
from verification.binding_sql import AS_OF, days
from verification.registry import PartialInputs, case, joined


def shown(rows):
    return rows.select(
        "subject_id", "violation_class", "rule_id", F.round("confidence", 6).alias("confidence"),
        joined("source_systems"), "is_cross_boundary", "evidence",
    )


def label_sql(violation_class, rule, confidence, sources, cross, body, evidence):
    """``evidence`` is a struct, or text that begins with a bracketed expression."""
    shown_evidence = f"CAST(to_json({evidence}) AS VARCHAR)" if evidence.startswith("{") else evidence
    return (
        f"SELECT x.subject_id, {violation_class} AS violation_class, {rule} AS rule_id, "
        f"CAST({confidence} AS DOUBLE) AS confidence, {sources} AS source_systems, {cross} AS is_cross_boundary, "
        f"{shown_evidence} AS evidence {body}"
    )


def by_source(value):
    """A JSON object of a component's values by source."""
    return (
        f"""('{{"{value}_by_source":{{' || (SELECT string_agg('"' || b.source || '":' || CAST(to_json(b.{value}) AS VARCHAR), ',' ORDER BY b.source) """
        f"""FROM by_source b WHERE b.component_id = x.component_id AND b.{value} IS NOT NULL) || '}}}}')"""
    )


FEATURE = "FROM feature x WHERE x.type <> 'group' AND "
PERMISSION_KEYS = (
    "('TRAN_PURCHORD','TRAN_VENDBILL','TRAN_VENDPYMT','TRAN_INVOICE','TRAN_CUSTPYMT','TRAN_JOURNAL','TRAN_PAYROLL',"
    "'LIST_VENDOR','LIST_CUSTJOB','LIST_ACCOUNT','ADMI_SETUP','ADMI_ACCTPERIODS','REPT_FINANCIALS')"
)
CATEGORY = """
SELECT sp.subject_id, count(*) AS n,
 bool_or(regexp_matches(t, 'security|iam|guardduty|waf')) AS sec,
 bool_or(regexp_matches(t, 'finance|accounting|payroll|treasury|billing|ap|ar|gl')) AS fin,
 bool_or(regexp_matches(t, 'user|directory|group')) AS idn,
 bool_or(regexp_matches(t, 'infra|ec2|compute|network')) AS inf
FROM sp JOIN (SELECT id, lower(name || ' ' || a0 || ' ' || a1 || ' ' || a2) AS t FROM permission WHERE is_privileged) p
ON p.id = sp.permission_id GROUP BY 1"""
JUSTIFIABLE = """
SELECT a.*, s.source AS subject_source, p.is_privileged, p.name AS permission_name FROM assignment a JOIN permission p ON p.id = a.permission_id
JOIN subject s ON s.id = a.subject_id WHERE a.is_active AND s.type <> 'group' AND s.source NOT IN ('netsuite', 'okta')"""

END_RESULTS = "[" + ", ".join("'" + p[3].replace("'", "''") + "'" for p in ESCALATION_PATTERNS) + "]"

SQL = {
    "sod": label_sql(1, "'SOD-R1'", "CASE WHEN x.source_count > 1 THEN 0.85 ELSE 0.95 END", "x.sources",
                     "x.source_count > 1", "FROM unit x JOIN violation v ON v.unit_id = x.unit_id",
        "{'sod_pair': [v.key_a, v.key_b], 'sources': string_split(x.sources, ',')}"),
    "sod_cross": label_sql(1, "'SOD-R1-CROSS'", "0.85", "x.sources", "true", f"""
FROM member x JOIN (SELECT component_id FROM member m JOIN sa ON sa.subject_id = m.subject_id GROUP BY 1
  HAVING bool_or(action LIKE 'lambda:%' OR action LIKE 'secretsmanager:%')
   AND bool_or(action LIKE 'netsuite:%' AND split_part(split_part(action, ':', 2), '.', 1) IN {PERMISSION_KEYS})) f
ON f.component_id = x.component_id WHERE x.sources LIKE '%aws_iam%' AND x.sources LIKE '%netsuite%'""",
        "{'aws_lambda_access': true, 'netsuite_financial': true}"),
    "escalation": label_sql(2, "'ESC-R1'", "x.confidence", "x.source", "false",
                            "FROM path x WHERE x.source NOT IN ('netsuite', 'okta')",
        f"{{'path_id': x.subject_id || '#' || x.pattern_no, 'end_result': {END_RESULTS}[x.pattern_no + 1], 'steps': x.steps}}"),
    "excessive_privilege": label_sql(
        3, "CASE WHEN permission_to_peer_median_ratio > 3 THEN 'EP-R1-HIGH' ELSE 'EP-R1-MED' END",
        "CASE WHEN permission_to_peer_median_ratio > 3 THEN 0.8 ELSE 0.6 END", "x.source", "false",
        FEATURE + "permission_to_peer_median_ratio > 2",
        "{'ratio': round_even(permission_to_peer_median_ratio, 2), 'total_permissions': total_permissions}"),
    "unused_privilege": label_sql(3, "'EP-R1-UNUSED'", "0.7", "x.source", "false",
                                  FEATURE + "usage_ratio < 0.1 AND total_permissions > 10",
        "{'usage_ratio': usage_ratio, 'total_permissions': total_permissions}"),
    "dormant": label_sql(
        4, "CASE WHEN days_since_last_activity > 90 THEN 'DA-R1-90' ELSE 'DA-R1-60' END",
        "CASE WHEN days_since_last_activity > 90 THEN 0.9 ELSE 0.7 END", "x.source", "false",
        FEATURE + "days_since_last_activity > 60 AND privileged_permissions > 0",
        "{'days_inactive': days_since_last_activity, 'privileged_permissions': privileged_permissions}"),
    "orphan_cross": label_sql(5, "'OA-R1-CROSS'", "0.95", "c.sources", "true", """
FROM member x JOIN by_component c ON c.component_id = x.component_id WHERE deleted_in IS NOT NULL AND active_in IS NOT NULL""",
        "{'deleted_in': string_split(c.deleted_in, ','), 'active_in': string_split(c.active_in, ',')}"),
    "orphan_inactive": label_sql(5, "'OA-R1-INACTIVE'", "0.85", "x.source", "false", """
FROM (SELECT s.id AS subject_id, s.source, a.n FROM subject s JOIN (SELECT subject_id, count(*) AS n FROM assignment WHERE is_active GROUP BY 1) a
  ON a.subject_id = s.id WHERE s.status = 'inactive') x""",
        "{'active_assignments': x.n}"),
    "creep_growth": label_sql(6, "'PC-R1-GROW'", "0.7", "x.source", "false",
                              FEATURE + "permissions_added_90d > 5 AND permissions_removed_90d = 0",
        "{'added_90d': permissions_added_90d, 'removed_90d': permissions_removed_90d}"),
    "creep_drift": label_sql(6, "'PC-R1-DRIFT'", "0.8", "x.source", "false", FEATURE + "net_drift_rate > 0.2",
        "{'net_drift_rate': round_even(net_drift_rate, 3)}"),
    "open_trust": label_sql(7, "'OT-R1-OPEN'", "0.95", "x.source", "false", """
FROM (SELECT id AS subject_id, source FROM subject WHERE source = 'aws_iam' AND trust_policy_open) x""",
        "{'trust_policy_open': true, 'principal': '*'}"),
    "cross_account": label_sql(7, "'OT-R1-XACCT'", "0.8", "x.source", "false", """
FROM (SELECT id AS subject_id, source FROM subject WHERE source = 'aws_iam' AND cross_account_trust AND cross_account_no_conditions) x""",
        "{'cross_account_trust': true, 'no_conditions': true, 'external_accounts': [lpad(substr(x.subject_id, 2), 12, '0')]}"),
    "missing_mfa": label_sql(
        8, "CASE WHEN x.p > 0 THEN 'MFA-R1-PRIV' ELSE 'MFA-R1-ACTIVE' END",
        "CASE WHEN x.p > 0 THEN 0.95 ELSE 0.7 END", "x.source", "false", """
FROM (SELECT s.id AS subject_id, s.source, s.status, c.privileged_permissions AS p FROM subject s
 JOIN perm_counts c ON c.subject_id = s.id WHERE s.type = 'human' AND s.mfa_enabled = false) x
WHERE x.p > 0 OR x.status = 'active'""",
        "CASE WHEN x.p > 0 THEN CAST(to_json({'mfa_enabled': false, 'privileged_permissions': x.p}) AS VARCHAR) ELSE '{\"mfa_enabled\":false}' END"),
    "status_mismatch": label_sql(9, "'CSI-R1-STATUS'", "0.9", "c.sources", "true", """
FROM member x JOIN by_component c ON c.component_id = x.component_id WHERE statuses > 1""",
        by_source("status")),
    "department_mismatch": label_sql(9, "'CSI-R1-DEPT'", "0.5", "c.department_in", "true", """
FROM member x JOIN by_component c ON c.component_id = x.component_id WHERE department_sources > 1 AND departments > 1""",
        by_source("department")),
    "name_mismatch": label_sql(9, "'CSI-R1-NAME'", "0.3", "c.sources", "true", """
FROM member x JOIN by_component c ON c.component_id = x.component_id WHERE names > 1""",
        by_source("name")),
    "service_multi": label_sql(10, "'SA-R1-MULTI'", "0.6", "x.source", "false",
                               "FROM feature x WHERE x.type = 'service_account' AND source_system_count > 2",
        "{'source_system_count': x.source_system_count}"),
    "service_address": label_sql(10, "'SA-R1-IPS'", "0.7", "x.source", "false",
                                 "FROM feature x WHERE x.type = 'service_account' AND distinct_source_ips_30d > 10",
        "{'distinct_ips': x.distinct_source_ips_30d}"),
    "service_entropy": label_sql(10, "'SA-R1-ENTROPY'", "0.6", "x.source", "false",
                                 "FROM feature x WHERE x.type = 'service_account' AND login_time_entropy > 3.0",
        "{'login_time_entropy': round_even(x.login_time_entropy, 3)}"),
    "config_change": label_sql(11, "'UCC-R1'", "0.7", "x.source", "false", """
FROM (SELECT s.id AS subject_id, s.source, c.actions FROM subject s JOIN (SELECT subject_id, list(DISTINCT action ORDER BY action) AS actions FROM (
   SELECT subject_id, action FROM sa WHERE action IN ('iam:UpdateAssumeRolePolicy', 'iam:PutRolePolicy', 'iam:PutUserPolicy',
    'iam:AttachRolePolicy', 'iam:AttachUserPolicy', 'iam:CreatePolicyVersion') OR action LIKE 'netsuite:ADMI\\_%' ESCAPE '\\'
   UNION SELECT sp.subject_id, 'netsuite:' || p.permission_key FROM sp JOIN permission p ON p.id = sp.permission_id
   WHERE p.permission_key IN ('ADMI_SETUP', 'ADMI_ACCTPERIODS')) GROUP BY 1) c ON c.subject_id = s.id
 WHERE s.type <> 'group' AND s.id NOT IN (SELECT sp.subject_id FROM sp JOIN permission p ON p.id = sp.permission_id
   WHERE p.type = 'group' AND regexp_matches(lower(p.name), 'admin|super|owner|root|devops|sre|platform'))) x""",
        "{'config_actions': x.actions, 'is_admin_group_member': false}"),
    "unjustified": label_sql(12, "'ABJ-R1-PRIV'", "0.6", "x.subject_source", "false",
                             "FROM justifiable x WHERE x.is_privileged AND coalesce(x.justification, '') = ''",
        "{'permission': x.permission_name, 'is_privileged': true, 'has_justification': false}"),
    "unknown_grantor": label_sql(12, "'ABJ-R1-UNKNOWN'", "0.5", "x.subject_source", "false",
                                 "FROM justifiable x WHERE x.granted_by IS NULL OR x.granted_by = 'unknown'",
        "{'permission': x.permission_name, 'granted_by': x.granted_by}"),
    "toxic_multi": label_sql(13, "'TRC-R1-MULTI'", "0.8", "s.source", "false", """
FROM category x JOIN subject s ON s.id = x.subject_id WHERE s.type <> 'group' AND x.n > 3
 AND x.sec::INT + x.fin::INT + x.idn::INT + x.inf::INT >= 2""",
        """{'privileged_role_count': x.n, 'categories': list_filter([CASE WHEN x.fin THEN 'financial' END, CASE WHEN x.idn THEN 'identity' END,
 CASE WHEN x.inf THEN 'infrastructure' END, CASE WHEN x.sec THEN 'security' END], lambda n: n IS NOT NULL)}"""),
    "toxic_security_finance": label_sql(13, "'TRC-R1-SECFIN'", "0.9", "s.source", "false", """
FROM category x JOIN subject s ON s.id = x.subject_id WHERE s.type <> 'group' AND x.sec AND x.fin""",
        "{'has_security_admin': true, 'has_financial_admin': true}"),
    "break_glass": label_sql(14, "'BGA-R1'", "0.9", "s.source", "false", f"""
FROM assignment x JOIN permission p ON p.id = x.permission_id JOIN subject s ON s.id = x.subject_id
WHERE x.is_active AND s.type <> 'group' AND {days(AS_OF, 'x.granted_at')} > 1 AND
 (regexp_matches(lower(p.name), 'emergency|break[-_]?glass|firecall|elevated[-_]?access|sos[-_]?admin')
  OR coalesce(regexp_matches(lower(p.tag), 'emergency|break[-_]?glass|firecall|elevated[-_]?access|sos[-_]?admin'), false))""",
        f"{{'role': p.name, 'assignment_age_days': {days(AS_OF, 'x.granted_at')}, 'expected_max_hours': 24}}"),
    "financial_bypass": label_sql(15, "'CBFB-R1-AWS-NS'", "CASE WHEN f.esc THEN 0.9 ELSE 0.8 END", "x.sources", "true", f"""
FROM member x JOIN (SELECT m.component_id,
   bool_or(m.source = 'aws_iam' AND EXISTS (SELECT 1 FROM sa WHERE sa.subject_id = m.subject_id
     AND (action LIKE '%lambda:%' OR action LIKE '%secretsmanager:%' OR action LIKE '%sts:%'))) AS api,
   bool_or(m.source = 'aws_iam' AND EXISTS (SELECT 1 FROM path WHERE path.subject_id = m.subject_id)) AS esc,
   bool_or(m.source = 'netsuite' AND EXISTS (SELECT 1 FROM sp JOIN permission p ON p.id = sp.permission_id
     WHERE sp.subject_id = m.subject_id AND p.permission_key IN {PERMISSION_KEYS})) AS fin,
   (SELECT list(DISTINCT p.permission_key ORDER BY p.permission_key) FROM member o JOIN sp ON sp.subject_id = o.subject_id
     JOIN permission p ON p.id = sp.permission_id
     WHERE o.component_id = m.component_id AND o.source = 'netsuite' AND p.permission_key IN {PERMISSION_KEYS}) AS keys
  FROM member m GROUP BY 1) f ON f.component_id = x.component_id
WHERE x.sources LIKE '%aws_iam%' AND x.sources LIKE '%netsuite%' AND f.api AND f.fin""",
        "{'aws_api_access': f.api, 'aws_escalation': f.esc, 'netsuite_financial_keys': f.keys[1:10]}"),
    "warehouse_bypass": label_sql(15, "'CBFB-R1-SF-NS'", "0.85", "x.sources", "true", """
FROM member x WHERE x.subject_id IN (SELECT sp.subject_id FROM sp JOIN permission p ON p.id = sp.permission_id
  GROUP BY 1 HAVING bool_or(lower(p.name) LIKE '%accountadmin%' AND p.source IN ('snowflake', 'aws_iam'))
   AND bool_or(p.permission_key = 'REPT_FINANCIALS' OR a0 LIKE '%REPT_FINANCIALS%' OR a1 LIKE '%REPT_FINANCIALS%' OR a2 LIKE '%REPT_FINANCIALS%'))""",
        "{'snowflake_accountadmin': true, 'netsuite_financial_reports': true}"),
}
EXTRA = {"category": CATEGORY, "justifiable": JUSTIFIABLE}


# Feature parts that single rules read; label_all runs on the whole feature table.
def counts(b):
    return access.permission_counts(b.estate)


def ratios(b):
    return peers.peer_scores(b.estate).select("subject_id", "permission_to_peer_median_ratio")


def usage(b):
    return behaviour.usage_ratios(b.estate)


def changes(b):
    return drift.permission_drift(b.estate, bind.DRIFT_AS_OF)


def activity(b):
    return behaviour.activity(b.estate, bind.EVENT_AS_OF)


def spans(b):
    return features.source_system_counts(b.members)


PARTS = {
    "excessive_privilege": (counts, ratios),
    "unused_privilege": (counts, usage),
    "dormant": (counts,),
    "creep_growth": (changes,),
    "creep_drift": (changes,),
    "missing_mfa": (counts,),
    "service_multi": (spans,),
    "service_address": (activity,),
    "service_entropy": (activity,),
}


def _register(name):
    @case(f"label_{name}", SQL[name], EXTRA)
    def _(b):
        inputs = PartialInputs(b, *PARTS[name]) if name in PARTS else b.rules
        return shown(labels.RULES[name](inputs))


for _name in labels.RULES:
    if _name != "warehouse_bypass":
        _register(_name)


@case("label_warehouse_bypass", label_sql(15, "'CBFB-R1-SF-NS'", "0.85", "x.sources", "true", """
FROM member x WHERE x.subject_id IN (SELECT sp.subject_id FROM sp JOIN permission p ON p.id = sp.permission_id
  GROUP BY 1 HAVING bool_or(p.name LIKE 'Break-Glass%') AND bool_or(p.permission_key IS NOT NULL))""",
    "{'snowflake_accountadmin': true, 'netsuite_financial_reports': true}"))
def _(b):
    # The bound names hold no account administrators: the break-glass roles take that name
    # (they come from the cloud source), and the declared keys become the report key.
    renamed = b.estate.permission.withColumn(
        "name", F.replace("name", F.lit("Break-Glass"), F.lit("ACCOUNTADMIN"))
    ).withColumn("permission_keys", F.transform("permission_keys", lambda k: F.lit("REPT_FINANCIALS")))
    inputs = labels.RuleInputs(b.estate.with_tables(permission=renamed), None, b.members, b.pairs, bind.AS_OF)
    return shown(labels.warehouse_bypass_labels(inputs))


@case(
    "label_all",
    "SELECT violation_class, rule_id, count(*) AS labels, count(DISTINCT subject_id) AS subjects FROM ("
    + " UNION ALL ".join(SQL.values()) + ") GROUP BY 1, 2",
    EXTRA,
)
def _(b):
    return (
        labels.label_all(b.kept.rules)
        .groupBy("violation_class", "rule_id")
        .agg(F.count("*").alias("labels"), F.countDistinct("subject_id").alias("subjects"))
    )
