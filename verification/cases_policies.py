"""Policy evaluation, lifecycle, feedback, similarity, suggestions."""

import json

from pyspark.sql import functions as F

from gatewarden import bind
from gatewarden.operators import access, policies as pol, suggestions
from gatewarden.operators.features import profile
from gatewarden.plans.durable import materialize
from gatewarden.plans.joins import skew_join
from gatewarden.plans.tables import literal_table
from verification.binding_sql import AS_OF, days
from verification.registry import case, joined, r6

# One policy per line: id, sources, types, departments, privileged only, custom filter, rules.
# A rule is (boost, [(feature, operator, threshold), ...]).
POLICIES = (
    ("PA", [], [], [], False, None, [(0.0, [("days_since_last_activity", "gt", 90), ("type", "eq", "human")])]),
    ("PB", ["okta", "entra"], [], [], False, None,
     [(0.4, [("total_permissions", "gte", 20)]), (-0.3, [("privileged_permissions", "gt", 0)])]),
    ("PC", [], ["service_account", "ai_agent"], [], True, None, [(0.1, [("mfa_usage_rate", "lt", 1.0)])]),
    ("PD", [], [], ["MACHINERY"], False, {"segment": "MACHINERY"}, [(0.0, [("status", "in", ["deleted", "inactive"])])]),
    ("PE", ["netsuite"], [], [], False, None,
     [(0.0, [("no_such_feature", "neq", 3)]), (0.2, [("no_such_feature", "gt", 3)]),
      (0.5, [("status", "not_in", ["active"]), ("no_such_feature", "not_in", [1])])]),
    ("PF", [], [], [], False, None, [(0.0, [("type", "gt", 5)])]),
)


def policy_tables(b):
    no_filter = F.lit(None).cast("map<string,string>")
    rows = [
        (p, "acme", f"policy {p}", "zero_trust", "active", "alert", "high", 0.7, "2001-01-01 00:00:00", s, t, d, v)
        for p, s, t, d, v, _, _ in POLICIES
    ] + [("PX", "other", "other", "custom", "active", "alert", "low", 0.5, "2001-01-01 00:00:00", [], [], [], False)]
    table = literal_table(
        b.spark,
        "id string, customer_id string, name string, category string, status string, action string, severity string, "
        "base_confidence double, suggested_at timestamp, scope_sources array<string>, scope_types array<string>, "
        "scope_departments array<string>, privileged_only boolean",
        rows,
    )
    custom = no_filter
    for p, *_, filters, _ in POLICIES:
        if filters:
            pairs = [F.lit(x) for kv in filters.items() for x in kv]
            custom = F.when(F.col("id") == p, F.create_map(*pairs)).otherwise(custom)
    rules = [(p, i, boost) for p, *_, rs in POLICIES for i, (boost, _) in enumerate(rs)]
    conditions = [
        (p, i, j, f, o, json.dumps(t))
        for p, *_, rs in POLICIES
        for i, (_, cs) in enumerate(rs)
        for j, (f, o, t) in enumerate(cs)
    ]
    return (
        table.withColumn("custom_filter", custom),
        literal_table(b.spark, pol.RULE_COLUMNS, rules),
        literal_table(b.spark, pol.CONDITION_COLUMNS, conditions),
    )


def simple_features(b):
    counts = access.permission_counts(b.estate).drop("permission_concentration")
    rows = profile(b.estate, bind.AS_OF).drop("trust_policy_open", "source").join(counts, "subject_id", "left")
    return rows.fillna(0, ["total_permissions", "privileged_permissions"])


def scoped_subjects(b, features):
    attributes = F.from_json("attributes", "map<string,string>")
    held = features.select("subject_id", (F.col("privileged_permissions") > 0).alias("has_privileged"))
    return b.estate.subject.select(
        F.col("id").alias("subject_id"), "source", "type", "department", attributes.alias("attributes")
    ).join(held, "subject_id")


SIMPLE = {"simple": f"""
SELECT s.id AS subject_id, s.source, s.type, s.department, s.segment, s.status,
  coalesce({days(AS_OF, 's.last_seen')}, -1) AS d, CASE WHEN s.mfa_enabled IS NULL THEN 0.5 WHEN s.mfa_enabled THEN 1 ELSE 0 END AS mfa,
  c.total_permissions AS t, c.privileged_permissions AS p FROM subject s JOIN perm_counts c ON c.subject_id = s.id""",
          "hit": """
SELECT 'PA' AS policy_id, subject_id, 0.7 AS confidence, '0' AS matched_rules FROM simple WHERE d > 90 AND type = 'human'
UNION ALL SELECT 'PB', subject_id, CASE WHEN t >= 20 AND p > 0 THEN 0.7 WHEN t >= 20 THEN 1.0 ELSE 0.4 END,
  concat_ws(',', CASE WHEN t >= 20 THEN '0' END, CASE WHEN p > 0 THEN '1' END)
  FROM simple WHERE source IN ('okta', 'entra') AND (t >= 20 OR p > 0)
UNION ALL SELECT 'PC', subject_id, 0.8, '0' FROM simple WHERE type IN ('service_account', 'ai_agent') AND p > 0 AND mfa < 1
UNION ALL SELECT 'PD', subject_id, 0.7, '0' FROM simple WHERE department = 'MACHINERY' AND status IN ('deleted', 'inactive')
UNION ALL SELECT 'PE', subject_id, CASE WHEN status <> 'active' THEN 1.0 ELSE 0.7 END, CASE WHEN status <> 'active' THEN '0,2' ELSE '0' END
  FROM simple WHERE source = 'netsuite'"""}


def evaluated(b):
    features = simple_features(b)
    tables = policy_tables(b)
    return pol.evaluate_policies(
        scoped_subjects(b, features), pol.feature_values(features), *tables, customer_id="acme"
    )


@case("policy_evaluation", """
SELECT policy_id, subject_id, round(confidence, 6)::DOUBLE AS confidence, matched_rules FROM hit""", SIMPLE)
def _(b):
    return evaluated(b).select(
        "policy_id", "subject_id", r6("confidence"),
        F.array_join(F.transform("matched_rules", lambda i: i.cast("string")), ",").alias("matched_rules"),
    )


@case("policy_evaluation_of_many", """
SELECT 'Q' || p_partkey AS policy_id, s.subject_id FROM part JOIN simple s
ON (p_partkey & 1 = 0 OR t > 1) AND (p_partkey & 2 = 0 OR p > 1) AND (p_partkey & 4 = 0) AND (p_partkey & 8 = 0) AND (p_partkey & 16 = 0)
WHERE p_partkey % 4 = 1 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 32 > 0""", SIMPLE)
def _(b):
    # Policies of scope "everybody", as many as there are parts; a feature without a value passes no comparison.
    policies, rules, conditions = many_policies(b)
    scope = {f"scope_{c}s": F.array().cast("array<string>") for c in ("source", "type", "department")}
    policies = policies.withColumns({
        **scope, "privileged_only": F.lit(False), "custom_filter": F.lit(None).cast("map<string,string>"),
    })
    features = simple_features(b)
    found = pol.evaluate_policies(
        scoped_subjects(b, features), pol.feature_values(features), policies, rules, conditions, customer_id="acme"
    )
    return found.select("policy_id", "subject_id")


@case("policy_feature_snapshot", """
SELECT subject_id, CAST(d AS VARCHAR) AS days_inactive, type FROM simple WHERE d > 90 AND type = 'human'""", SIMPLE)
def _(b):
    return evaluated(b).where(F.col("policy_id") == "PA").select(
        "subject_id", F.col("feature_snapshot")["days_since_last_activity"].alias("days_inactive"),
        F.col("feature_snapshot")["type"].alias("type"),
    )


@case("policy_hits_by_policy", "SELECT policy_id, count(*) AS hits FROM hit GROUP BY 1", SIMPLE)
def _(b):
    return evaluated(b).groupBy("policy_id").agg(F.count("*").alias("hits"))


def many_policies(b):
    """One policy per part, so that policy tables grow with the data."""
    p = F.col("p_partkey")
    part = b.table("part")
    names = ("total_permissions", "privileged_permissions", "usage_ratio", "type", "status")
    policies = part.select(
        F.concat(F.lit("Q"), p.cast("string")).alias("id"), F.lit("acme").alias("customer_id"),
        F.concat(F.lit("policy "), p.cast("string")).alias("name"),
        F.element_at(F.array(*[F.lit(c) for c in ("zero_trust", "anomaly")]), (p % 2 + 1).cast("int")).alias("category"),
        F.element_at(
            F.array(*[F.lit(s) for s in ("suggested", "active", "paused", "dismissed")]), (p % 4 + 1).cast("int")
        ).alias("status"),
        F.lit("alert").alias("action"), F.when(p % 10 == 0, "odd").otherwise("high").alias("severity"),
        ((p % 12) / 10.0).alias("base_confidence"),
        (F.to_timestamp(F.lit("2001-01-01")) + F.make_dt_interval((p % 30).cast("int"))).alias("suggested_at"),
        (p % 13).cast("int").alias("approvals"), F.lit(10).alias("graduation_threshold"),
        F.lit(0).alias("true_positives"), F.lit(0).alias("false_positives"), F.lit(0).alias("true_negatives"),
        F.lit(0).alias("false_negatives"),
    )
    rules = part.where(p % 5 != 0).select(
        F.concat(F.lit("Q"), p.cast("string")).alias("policy_id"), F.lit(0).alias("rule_no"),
        ((p % 13) / 10.0 - 0.6).alias("confidence_boost"),
    )
    chosen = F.array(*[F.when((F.shiftright(p, i) % 2) == 1, F.lit(n)) for i, n in enumerate(names)])
    conditions = part.where(p % 5 != 0).select(
        F.concat(F.lit("Q"), p.cast("string")).alias("policy_id"), F.lit(0).alias("rule_no"),
        F.posexplode(F.array_compact(chosen)).alias("condition_no", "feature_name"),
        F.when(p % 7 == 0, "like").otherwise("gt").alias("operator"), F.lit("1").alias("threshold"),
    )
    return policies, rules, conditions


@case("policies_valid", """
SELECT 'Q' || p_partkey AS id FROM part WHERE p_partkey % 10 <> 0 AND (p_partkey % 12) / 10.0 BETWEEN 0 AND 1""")
def _(b):
    return pol.valid_policies(many_policies(b)[0])[0].select("id")


@case("policy_rules_rejected", """
SELECT 'Q' || p_partkey AS policy_id FROM part WHERE p_partkey % 5 <> 0
 AND NOT (p_partkey % 32 > 0 AND p_partkey % 7 <> 0 AND p_partkey % 13 BETWEEN 1 AND 11)""")
def _(b):
    _, rules, conditions = many_policies(b)
    rounded = rules.withColumn("confidence_boost", F.round("confidence_boost", 6))
    return pol.valid_rules(rounded, conditions)[1].select("policy_id")


@case("policy_listing", """
SELECT 'Q' || p_partkey AS id FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 2 = 1""")
def _(b):
    return pol.list_policies(many_policies(b)[0], "acme", "active", "anomaly").select("id")


LIFE = """
SELECT 'Q' || p_partkey AS id,
 CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 5 <> 0 THEN 'paused' ELSE 'approved' END
   WHEN 1 THEN 'paused' WHEN 2 THEN CASE WHEN p_partkey % 5 <> 0 THEN 'paused' ELSE 'approved' END ELSE 'dismissed' END AS s,
 p_partkey % 13 + CASE WHEN p_partkey % 4 IN (0, 2) THEN 1 ELSE 0 END AS approvals,
 CASE WHEN p_partkey % 4 IN (0, 2) THEN 0 ELSE 1 END + CASE WHEN p_partkey % 4 = 1 OR (p_partkey % 4 IN (0, 2) AND p_partkey % 5 <> 0) THEN 0 ELSE 1 END AS rejected
FROM part"""


@case("policy_lifecycle", """
SELECT id, CASE WHEN approvals >= 10 THEN 'graduated' ELSE s END AS status, approvals,
 rejected + CASE WHEN approvals >= 10 THEN 0 ELSE 1 END AS rejected_events FROM life""", {"life": LIFE})
def _(b):
    policies, rules, _ = many_policies(b)
    events = policies.select(
        F.col("id").alias("policy_id"),
        F.posexplode(F.array(F.lit("approve"), F.lit("pause"), F.lit("graduate"))).alias("seq", "kind"),
        F.lit("me").alias("actor"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("action_override"),
        F.lit(None).cast("string").alias("severity_override"), F.to_timestamp(F.lit("2001-02-02")).alias("at"),
    )
    return pol.lifecycle(policies, rules, events).select("id", "status", "approvals", "rejected_events")


FEEDBACK = {"feedback": """
SELECT 'Q' || (l_partkey % 50) AS id, count(CASE l_linenumber % 3 WHEN 0 THEN 1 END) AS tp,
  count(CASE l_linenumber % 3 WHEN 1 THEN 1 END) AS fp, count(CASE l_linenumber % 3 WHEN 2 THEN 1 END) AS fn
FROM lineitem GROUP BY 1"""}


def feedback(b):
    n = F.col("l_linenumber") % 3
    return b.table("lineitem").select(
        F.concat(F.lit("Q"), (F.col("l_partkey") % 50).cast("string")).alias("policy_id"),
        F.when(n == 0, "true_positive").when(n == 1, "false_positive").otherwise("false_negative").alias("verdict"),
    )


@case("policy_performance", """
SELECT 'Q' || p_partkey AS policy_id, coalesce(tp, 0) AS true_positives, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
 round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score,
 coalesce(tp + fp + fn, 0) AS total_feedback, p_partkey % 13 >= 10 AS ready_for_graduation
FROM part LEFT JOIN feedback f ON f.id = 'Q' || p_partkey""", FEEDBACK)
def _(b):
    counted = pol.feedback_counters(many_policies(b)[0], feedback(b))
    return pol.policy_performance(counted).select(
        "policy_id", "true_positives", r6("precision"), r6("recall"), r6("f1_score"), "total_feedback",
        "ready_for_graduation",
    )


@case("graduation_candidates", "SELECT 'Q' || p_partkey AS id FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 13 >= 10")
def _(b):
    return pol.graduation_candidates(many_policies(b)[0]).select("id")


SETS = {"policy_set": """
SELECT 'Q' || p_partkey AS policy_id, CASE WHEN p_partkey % 2 = 0 THEN 'zero_trust' ELSE 'anomaly' END AS category, (p_partkey % 32)::INT AS mask,
  array_to_string(list_filter([CASE WHEN p_partkey & 2 > 0 THEN 'privileged_permissions' END, CASE WHEN p_partkey & 16 > 0 THEN 'status' END,
   CASE WHEN p_partkey & 1 > 0 THEN 'total_permissions' END, CASE WHEN p_partkey & 8 > 0 THEN 'type' END,
   CASE WHEN p_partkey & 4 > 0 THEN 'usage_ratio' END], lambda x: x IS NOT NULL), ',') AS features
FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 32 > 0"""}


@case("similar_policies", """
SELECT a.policy_id, a.category, a.features, b.features AS other, round(bit_count(a.mask & b.mask) / bit_count(a.mask | b.mask)::DOUBLE, 6) AS similarity,
  b.policies - CASE WHEN a.features = b.features THEN 1 ELSE 0 END AS links
FROM policy_set a JOIN (SELECT category, features, mask, count(*) AS policies FROM policy_set GROUP BY category, features, mask) b
ON a.category = b.category AND 2 * bit_count(a.mask & b.mask) >= bit_count(a.mask | b.mask)""", SETS)
def _(b):
    # What is like every policy? The policies of a set are its rows with similarity 1.
    policies, _, conditions = many_policies(b)
    links = pol.policy_links(*pol.similar_policies(policies, conditions))
    return links.select("policy_id", "category", joined("features"), joined("other"), r6("similarity"), "links")


@case("similar_policy_sets", "SELECT policy_id, category, features FROM policy_set", SETS)
def _(b):
    policies, _, conditions = many_policies(b)
    return pol.similar_policies(policies, conditions)[1].select("policy_id", "category", joined("features"))


# --- conditions in long form -----------------------------------------------------------

OPERATOR_CASES = (
    ("number", "gt", "20"), ("number", "lte", "20"), ("number", "eq", "20"), ("number", "neq", "20"),
    ("number", "in", "[20, 21]"), ("number", "not_in", "[20, 21]"), ("text", "eq", '"human"'),
    ("text", "gt", "5"), ("missing", "eq", "null"), ("missing", "eq", "1"), ("missing", "neq", "1"),
    ("missing", "gt", "1"), ("missing", "not_in", "[1]"), ("missing", "in", "[1]"), ("text", "in", '"a human here"'),
    ("number", "in", "5"), ("number", "not_in", "5"), ("number", "eq", '"20"'),
)


@case("condition_truth_table", """
SELECT i AS case_no, count(*) AS holds FROM (SELECT total_permissions AS n, type FROM subject s JOIN perm_counts c ON c.subject_id = s.id) s,
 (SELECT unnest(range(18)) AS i) WHERE
 CASE i WHEN 0 THEN n > 20 WHEN 1 THEN n <= 20 WHEN 2 THEN n = 20 WHEN 3 THEN n <> 20 WHEN 4 THEN n IN (20, 21)
  WHEN 5 THEN n NOT IN (20, 21) WHEN 6 THEN type = 'human' WHEN 8 THEN true WHEN 10 THEN true WHEN 12 THEN true
  WHEN 14 THEN type = 'human' ELSE false END GROUP BY 1""")
def _(b):
    values = F.array(
        F.struct(F.lit("number").alias("name"), pol.typed(F.col("total_permissions"), "bigint").alias("value")),
        F.struct(F.lit("text").alias("name"), pol.typed(F.col("type"), "string").alias("value")),
        F.struct(F.lit("missing").alias("name"), pol.typed(F.lit(None).cast("int"), "int").alias("value")),
    )
    rows = [(i, *c) for i, c in enumerate(OPERATOR_CASES)]
    cases = literal_table(b.spark, "case_no int, name string, operator string, threshold string", rows)
    parsed = materialize(cases.withColumn("threshold", pol.parsed_threshold(F.col("threshold"))), "cases")
    judged = skew_join(simple_features(b).select(F.inline(values)), parsed, "name")
    holds = pol.condition_holds(F.col("value"), F.col("operator"), F.col("threshold"))
    return judged.where(holds).groupBy("case_no").agg(F.count("*").alias("holds"))


# --- suggestions --------------------------------------------------------------------------

CASES = {
    "Dormant privileged access — 90 day threshold": "days_since_last_activity > 90 AND privileged_permissions > 0 AND type = 'human'",
    "Missing MFA on privileged human accounts": "mfa_usage_rate < 0.01 AND privileged_permissions > 0 AND type = 'human'",
    "Excessive privilege — 3x peer median": "permission_to_peer_median_ratio > 3.0 AND total_permissions > 5",
    "Service account with high IP diversity": "type = 'service_account' AND distinct_source_ips_30d > 10",
    "AI agent permission growth": "type = 'ai_agent' AND permissions_added_30d > 3 AND permissions_removed_30d = 0",
    "Cross-boundary financial access": "source_system_count >= 2 AND privileged_permissions > 0 AND sod_pair_membership_count > 0",
    "Open trust policy — Principal:*": "type IN ('service_account', 'ai_agent') AND trust_policy_open",
    "Orphaned cross-system identity": "cross_system_consistency_score < 0.5 AND source_system_count >= 2",
}
CRITICAL = (
    "Missing MFA on privileged human accounts", "Cross-boundary financial access", "Open trust policy — Principal:*",
)
PATTERNS = {
    suggestions.LOW_USAGE: ("usage_ratio < 0.05 AND total_permissions > 3 AND type = 'human'", 0.6, "n > 0.1 * total"),
    suggestions.SPANNING_AGENTS: ("type = 'ai_agent' AND source_system_count >= 2", 0.75, "true"),
    suggestions.SOX_MONITORING: ("sod_pair_membership_count > 0", 0.9, "true"),
    suggestions.CROSS_BOUNDARY: ("source_system_count >= 2 AND privileged_permissions > 0", 0.95, "true"),
}
TEMPLATE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS name, n AS affected_count, least(1.0, least(1.0, 0.3 + 0.7 * n / total) + {0.2 if name in CRITICAL else 0.0}) AS priority "
    f"FROM (SELECT count(*) FILTER (WHERE {where}) AS n, count(*)::DOUBLE AS total FROM feature) WHERE n > 0"
    for name, where in CASES.items()
)
PATTERN_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS name, n AS affected_count, {priority} AS priority "
    f"FROM (SELECT count(*) FILTER (WHERE {where}) AS n, count(*)::DOUBLE AS total FROM feature) WHERE n > 0 AND {gate}"
    for name, (where, priority, gate) in PATTERNS.items()
)
DEPARTMENT_SQL = """
SELECT 'High average permissions in ' || f.department AS name, count(*) AS affected_count, 0.5 AS priority FROM feature f
JOIN (SELECT department, avg(total_permissions) AS m FROM feature WHERE department <> 'unknown' GROUP BY 1
 HAVING count(*) >= 3 AND avg(total_permissions) > 15) d ON d.department = f.department AND f.total_permissions > d.m GROUP BY 1"""
ALL_SQL = f"{TEMPLATE_SQL} UNION ALL {PATTERN_SQL} UNION ALL {DEPARTMENT_SQL}"


@case("template_suggestions", f"SELECT name, affected_count, round(priority, 6)::DOUBLE AS priority FROM ({TEMPLATE_SQL})")
def _(b):
    return suggestions.template_suggestions(b.features).select("name", "affected_count", r6("priority"))


@case("data_driven_suggestions", f"SELECT name, affected_count, round(priority, 6)::DOUBLE AS priority FROM ({PATTERN_SQL})")
def _(b):
    return suggestions.data_driven_suggestions(b.features).select("name", "affected_count", r6("priority"))


@case("department_suggestions", f"SELECT name, affected_count, round(priority, 6)::DOUBLE AS priority FROM ({DEPARTMENT_SQL})")
def _(b):
    return suggestions.department_suggestions(b.features).select("name", "affected_count", r6("priority"))


@case("suggestion_subjects", " UNION ALL ".join(
    [f"SELECT '{n}' AS name, subject_id FROM feature WHERE {w}" for n, w in CASES.items()]
    + [f"SELECT '{n}' AS name, subject_id FROM feature WHERE {w}" for n, (w, _, _) in PATTERNS.items()]
    + ["""SELECT 'High average permissions in ' || f.department, subject_id FROM feature f
 JOIN (SELECT department, avg(total_permissions) AS m FROM feature WHERE department <> 'unknown' GROUP BY 1
 HAVING count(*) >= 3 AND avg(total_permissions) > 15) d ON d.department = f.department AND f.total_permissions > d.m"""]
))
def _(b):
    return suggestions.suggestion_subjects(b.features).select("name", "subject_id")


@case("ranked_suggestions", f"""
SELECT name, affected_count, round(priority, 6)::DOUBLE AS priority, (SELECT count(*) FROM feature) AS total_subjects
FROM ({ALL_SQL}) WHERE name <> 'Missing MFA on privileged human accounts'""")
def _(b):
    existing = b.estate.permission.select("name").unionByName(
        literal_table(b.spark, "name string", [("Missing MFA on privileged human accounts",)])
    )
    return suggestions.suggest(b.features, existing).select(
        "name", "affected_count", r6("priority"), "total_subjects"
    )
