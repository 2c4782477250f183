"""Signals, severity, ranking, rollups, remediation."""

from pyspark.sql import functions as F

from gatewarden import bind
from gatewarden.functions.fixed_values import MODEL_IDS, VIOLATION_NAMES
from gatewarden.functions.scalars import as_of_lit
from gatewarden.operators import access, graph, remediation, signals
from gatewarden.operators.features import profile
from gatewarden.operators.peers import peer_scores
from gatewarden.session import prepare
from verification.cases_rules import EXTRA, SQL
from verification.registry import case, joined, r6

REPORT_SEVERITY = """CASE WHEN violation_class IN (1, 2, 15) AND confidence >= 0.9 THEN 'critical'
 WHEN violation_class IN (1, 2, 15) AND confidence >= 0.8 THEN 'high' WHEN confidence >= 0.85 THEN 'high'
 WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END"""
NAMES = "CASE violation_class " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in VIOLATION_NAMES.items()) + " END"
MODELS = "CASE violation_class " + " ".join(f"WHEN {c} THEN '{m}'" for c, m in MODEL_IDS.items()) + " END"
LABELS = {**EXTRA, "label_row": " UNION ALL ".join(SQL.values())}
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


class CountsOnly:
    """Rule inputs whose features are the permission counts alone."""

    def __init__(self, b):
        self.estate, self.as_of = b.estate, bind.AS_OF
        self.features = access.permission_counts(b.estate)


def label_signals(b):
    return signals.signals_from_labels(b.labels, b.estate)


def ranked_excess(spark, sf_dir):
    """Subjects with more than twice their peers' median of permissions, ranked."""
    estate = bind.estate(prepare(spark), sf_dir)
    scores = peer_scores(estate).drop("peer_department", "peer_type")
    facts = profile(estate, bind.AS_OF).select("subject_id", "source", "type", "department")
    ratio = F.col("permission_to_peer_median_ratio")
    rows = (
        scores.where(ratio > 2)
        .join(facts, "subject_id")
        .withColumn("confidence", F.when(ratio > 3, 0.8).otherwise(0.6))
        .withColumn("rule_id", F.when(ratio > 3, "EP-R1-HIGH").otherwise("EP-R1-MED"))
        .withColumn("severity", signals.report_severity(F.col("confidence"), F.lit(3)))
        .select(
            "subject_id", "source", "type", "department", "total_permissions",
            r6("permission_to_peer_median_ratio", "ratio"), "rule_id", "confidence", "severity",
        )
    )
    return signals.rank(rows, "subject_id")


@case("ranked_excess", """
SELECT x.id AS subject_id, x.source, x.type, coalesce(department, 'unknown') AS department, c.total_permissions,
 round(r.ratio, 6) AS ratio, CASE WHEN r.ratio > 3 THEN 'EP-R1-HIGH' ELSE 'EP-R1-MED' END AS rule_id,
 CASE WHEN r.ratio > 3 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, 'medium' AS severity
FROM subject x JOIN perm_counts c ON c.subject_id = x.id JOIN peer_ratio r ON r.subject_id = x.id
WHERE x.type <> 'group' AND r.ratio > 2""")
def _(b):
    return ranked_excess(b.spark, b.sf_dir)


@case("label_signals", f"""
SELECT l.subject_id, s.display_name AS subject, s.type AS subject_type, coalesce(nullif(s.department, ''), 'N/A') AS department,
 {NAMES} AS violation, violation_class, confidence, {REPORT_SEVERITY} AS severity, rule_id AS rule, source_systems AS sources,
 s.mfa_enabled AS mfa FROM label_row l JOIN subject s ON s.id = l.subject_id""", LABELS)
def _(b):
    return label_signals(b).drop("evidence").withColumn("sources", joined("sources"))


@case("signal_rollup_severity", f"""
SELECT severity, count(*) AS n FROM (SELECT {REPORT_SEVERITY} AS severity FROM label_row) GROUP BY 1""", LABELS)
def _(b):
    return signals.rollup_by(label_signals(b), "severity")


@case("signal_rollup_violation", f"""
SELECT violation, count(*) AS n FROM (SELECT {NAMES} AS violation FROM label_row) GROUP BY 1""", LABELS)
def _(b):
    return signals.rollup_by(label_signals(b), "violation")


@case("signal_rollup_source", """
SELECT source, count(*) AS n FROM (SELECT unnest(string_split(source_systems, ',')) AS source FROM label_row) GROUP BY 1""", LABELS)
def _(b):
    return signals.rollup_by_source(label_signals(b))


@case("signals_of_source", f"""
SELECT subject_id, rule_id AS rule, count(*) AS n FROM label_row WHERE list_contains(string_split(source_systems, ','), 'okta') GROUP BY 1, 2""", LABELS)
def _(b):
    return signals.of_source(label_signals(b), "okta").groupBy("subject_id", "rule").agg(F.count("*").alias("n"))


DETECTIONS = "SELECT " + MODELS + " AS model_id, subject_id AS entity_id, confidence, row_number() OVER () AS seq, rule_id FROM label_row"
BEST = """SELECT model_id, entity_id, max(confidence) AS confidence FROM detection GROUP BY 1, 2"""
SIGNAL = """
SELECT b.model_id || '/' || b.entity_id AS signal_id, b.model_id, b.entity_id, round(b.confidence, 4) AS confidence,
 CASE WHEN confidence > 0.9 AND coalesce(c.n, 0) > 0 THEN 'critical'
  WHEN confidence > 0.8 OR coalesce(d.n, 0) + coalesce(p.n, 0) > 10 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END AS severity,
 coalesce(d.n, 0) + coalesce(p.n, 0) AS total_reach, coalesce(c.n, 0)::BIGINT AS critical_resources
FROM best b LEFT JOIN (SELECT subject_id, count(*) AS n FROM reach GROUP BY 1) d ON d.subject_id = b.entity_id
LEFT JOIN critical_reach c ON c.subject_id = b.entity_id
LEFT JOIN (SELECT subject_id, count(*) AS n FROM path GROUP BY 1) p ON p.subject_id = b.entity_id"""
SIGNALS = {**LABELS, "detection": DETECTIONS, "best": BEST, "signal": SIGNAL}


def detections(b):
    catalogue = F.broadcast(signals.model_catalogue(b.spark).select("violation_class", "model_id"))
    actions = F.array(*[F.lit(a) for a in ("revoke_permission", "disable_account", "require_mfa", "flag_for_review", "quarantine")])
    return b.labels.join(catalogue, "violation_class").select(
        "model_id", F.col("subject_id").alias("entity_id"), "confidence",
        F.try_element_at(actions, (F.substr("subject_id", F.lit(2)).cast("bigint") % 5 + 1).cast("int")).alias("action"),
        F.element_at("source_systems", 1).alias("source"), F.concat_ws("/", "rule_id", "evidence").alias("seq"),
    )


def model_signals(b):
    best = signals.best_per_entity(detections(b)).drop("seq")
    return signals.build_signals(best, graph.blast_radius(b.estate), as_of_lit(bind.AS_OF))


@case("best_signal_per_entity", "SELECT model_id, entity_id, confidence FROM best", SIGNALS)
def _(b):
    return signals.best_per_entity(detections(b)).select("model_id", "entity_id", "confidence")


@case("model_signals", """
SELECT signal_id, model_id, entity_id, confidence, severity, total_reach, critical_resources,
 confidence < 0.7 OR severity IN ('critical', 'high') AS requires_human,
 CASE WHEN severity IN ('critical', 'high') THEN 'staged' ELSE 'immediate' END AS rollback FROM signal""", SIGNALS)
def _(b):
    return model_signals(b).select(
        "signal_id", "model_id", "entity_id", "confidence", "severity", "blast_radius.total_reach",
        "blast_radius.critical_resources", "requires_human", "rollback",
    )


@case("ranked_signal_page", f"""
SELECT signal_id, severity, confidence FROM signal ORDER BY {RANK}, confidence DESC, signal_id LIMIT 50 OFFSET 50""", SIGNALS)
def _(b):
    ranked = signals.rank(model_signals(b).select("signal_id", "severity", "confidence"), "signal_id")
    return signals.page(ranked, 2, 50)


@case("signal_listing_total", "SELECT count(*) AS total FROM signal", SIGNALS)
def _(b):
    return signals.total(model_signals(b))


@case("signal_page_after", f"""
SELECT signal_id, severity, confidence FROM signal WHERE severity IN ('medium', 'low') OR (severity = 'high' AND (confidence < 0.9
  OR (confidence = 0.9 AND signal_id > 'ZT-02/S5'))) ORDER BY {RANK}, confidence DESC, signal_id LIMIT 100""", SIGNALS)
def _(b):
    columns = model_signals(b).select("signal_id", "severity", "confidence")
    return signals.page_after(columns, 100, "signal_id", ("high", 0.9, "ZT-02/S5"))


@case("filtered_signals", """
SELECT signal_id, severity FROM signal WHERE severity = 'high' AND model_id = 'SOX-02'""", SIGNALS)
def _(b):
    return signals.list_signals(
        model_signals(b), severity="high", model_id="SOX-02", requires_human=True, status="pending"
    ).select("signal_id", "severity")


@case("finding_signals", """
SELECT s.display_name AS subject, upper(p.source) || '-' || substr(min_action, 1, 20) AS rule, count(*) > 0 AS present
FROM (SELECT path.*, (SELECT min(action) FROM pattern WHERE pattern.pattern_no = path.pattern_no) AS min_action FROM path) p
JOIN subject s ON s.id = p.subject_id WHERE p.source IN ('netsuite', 'okta', 'healthcare', 'trading') GROUP BY 1, 2""")
def _(b):
    rows = signals.signals_from_findings(b.estate)
    return rows.select("subject", "rule", F.lit(True).alias("present"))


@case("finding_signals_unseen", """
SELECT DISTINCT s.display_name AS subject, upper(p.source) || '-' || substr(min_action, 1, 20) AS rule,
  CASE p.source WHEN 'netsuite' THEN 'SoD Violation (ERP)' WHEN 'healthcare' THEN 'HIPAA Violation (Healthcare)' ELSE 'Identity Risk (IdP)' END AS violation
FROM (SELECT path.*, (SELECT min(action) FROM pattern WHERE pattern.pattern_no = path.pattern_no) AS min_action FROM path) p
JOIN subject s ON s.id = p.subject_id WHERE p.source IN ('netsuite', 'okta', 'healthcare')
AND NOT EXISTS (SELECT 1 FROM subject q WHERE q.display_name = s.display_name AND q.status = 'inactive'
  AND upper(p.source) || '-' || substr(min_action, 1, 20) = upper(q.source) || '-iam:AttachRolePolicy')""")
def _(b):
    already = b.estate.subject.where(F.col("status") == "inactive").select(
        F.col("display_name").alias("subject"),
        F.concat(F.upper("source"), F.lit("-iam:AttachRolePolicy")).alias("rule"),
    )
    return signals.signals_from_findings(b.estate, already).select("subject", "rule", "violation")


# The headline run: labels of all rules and findings of all sources, deduplicated and ranked.
ALL_SIGNALS = f"""
SELECT s.display_name AS subject, l.rule_id AS rule, {NAMES} AS violation, violation_class, {REPORT_SEVERITY} AS severity, 'label' AS kind
FROM label_row l JOIN subject s ON s.id = l.subject_id
UNION ALL
SELECT subject, rule, violation, violation_class, CASE WHEN confidence >= 0.95 THEN 'critical' WHEN confidence >= 0.9 THEN 'high' ELSE 'medium' END, 'finding'
FROM (SELECT s.display_name AS subject, upper(p.source) || '-' || substr(min_action, 1, 20) AS rule, max(p.confidence) AS confidence,
   max(CASE p.source WHEN 'netsuite' THEN 'SoD Violation (ERP)' WHEN 'healthcare' THEN 'HIPAA Violation (Healthcare)' ELSE 'Identity Risk (IdP)' END) AS violation,
   max(CASE p.source WHEN 'netsuite' THEN 1 WHEN 'healthcare' THEN 15 ELSE 9 END) AS violation_class
 FROM (SELECT path.*, (SELECT min(action) FROM pattern WHERE pattern.pattern_no = path.pattern_no) AS min_action FROM path) p
 JOIN subject s ON s.id = p.subject_id WHERE p.source IN ('netsuite', 'okta', 'healthcare') GROUP BY 1, 2)"""
ALL = {**LABELS, "all_signal": ALL_SIGNALS}


def all_signals(b):
    labelled = label_signals(b)
    found = signals.signals_from_findings(b.estate, labelled)
    return labelled.withColumn("kind", F.lit("label")).unionByName(found.withColumn("kind", F.lit("finding")))


@case("pipeline_signals", "SELECT subject, rule, violation, violation_class, severity, kind FROM all_signal", ALL)
def _(b):
    ranked = signals.rank(all_signals(b), "subject_id")
    return ranked.select("subject", "rule", "violation", "violation_class", "severity", "kind")


@case("pipeline_rollup_severity", "SELECT severity, count(*) AS n FROM all_signal GROUP BY 1", ALL)
def _(b):
    return signals.rollup_by(all_signals(b), "severity")


@case("pipeline_rollup_violation", "SELECT violation, count(*) AS n FROM all_signal GROUP BY 1", ALL)
def _(b):
    return signals.rollup_by(all_signals(b), "violation")


@case("pipeline_rollup_source", f"""
SELECT source, count(*) AS n FROM (SELECT unnest(string_split(source_systems, ',')) AS source FROM label_row
 UNION ALL SELECT lower(split_part(rule, '-', 1)) FROM all_signal WHERE kind = 'finding') GROUP BY 1""", ALL)
def _(b):
    return signals.rollup_by_source(all_signals(b))


@case("model_catalogue_use", """
SELECT model_id, count(*) AS detections FROM detection GROUP BY 1""", SIGNALS)
def _(b):
    catalogue = signals.model_catalogue(b.spark)
    return b.labels.join(F.broadcast(catalogue), "violation_class").groupBy("model_id").agg(
        F.count("*").alias("detections")
    )


# --- remediation --------------------------------------------------------------------

STEP = """
SELECT signal_id, entity_id, i AS step_order,
 CASE k WHEN 0 THEN 'detach_policy' WHEN 1 THEN 'disable_account' WHEN 2 THEN 'enforce_mfa' WHEN 3 THEN 'create_review_ticket' ELSE 'quarantine' END AS action,
 k IN (0, 1, 2) AS is_reversible,
 CASE k WHEN 0 THEN 'attach_policy' WHEN 1 THEN 'enable_account' WHEN 2 THEN 'remove_mfa_requirement' END AS rollback_action,
 CASE k WHEN 0 THEN 'Detach permission ''' || 'F' || i || ''' from entity ' || entity_id WHEN 1 THEN 'Disable account ' || entity_id || ' in here'
   WHEN 2 THEN 'Enforce MFA on ' || entity_id || ' in here' WHEN 3 THEN 'Create access review ticket for ' || entity_id
   ELSE 'Execute ''quarantine'' on ' || entity_id || ' in here' END AS description
FROM (SELECT 'S/' || id AS signal_id, id AS entity_id, ingest_seq % 5 AS k FROM subject) s,
 LATERAL (SELECT unnest(CASE WHEN k = 0 THEN [1, 2, 3] ELSE [1] END) AS i)"""
PLAN = {"step": STEP}


def plan_signals(b):
    k = F.col("ingest_seq") % 5
    actions = ("revoke_permission", "disable_account", "require_mfa", "flag_for_review", "quarantine")
    return b.estate.subject.select(
        F.concat(F.lit("S/"), "id").alias("signal_id"), F.col("id").alias("entity_id"),
        F.lit("here").alias("source"), F.element_at(F.array(*[F.lit(a) for a in actions]), (k + 1).cast("int")).alias("action"),
        F.lit("SOX-01").alias("model_id"), F.lit("high").alias("severity"),
        F.array(F.lit("F1"), F.lit("F2"), F.lit("F3")).alias("flagged_permissions"),
        (k < 3).alias("requires_human"), F.lit("staged").alias("rollback"),
        (F.col("ingest_seq") % 4).alias("total_reach"), (F.col("ingest_seq") % 3).alias("critical_resources"),
    )


def results(b, steps):
    """Every seventh signal fails at its last step."""
    key = F.substr("entity", F.lit(2)).cast("bigint")
    return steps.select("signal_id", "step_order", F.col("target_entity").alias("entity")).select(
        "signal_id",
        "step_order",
        (~((key % 7 == 0) & (F.col("step_order") == F.when(key % 5 == 0, 3).otherwise(1)))).alias("ok"),
    )


@case("remediation_steps", "SELECT signal_id, step_order, action, is_reversible, rollback_action, description FROM step", PLAN)
def _(b):
    return remediation.plan_steps(plan_signals(b)).select(
        "signal_id", "step_order", "action", "is_reversible", "rollback_action", "description"
    )


@case("remediation_plans", """
SELECT 'plan/S/' || id AS plan_id, CASE WHEN ingest_seq % 5 = 0 THEN 3 ELSE 1 END AS steps,
 CASE WHEN ingest_seq % 5 = 0 THEN '3' ELSE '1' END || ' remediation step(s)' ||
 CASE WHEN ingest_seq % 4 > 0 THEN ', affects ' || (ingest_seq % 4) || ' resources' ELSE '' END ||
 CASE WHEN ingest_seq % 3 > 0 THEN ', including ' || (ingest_seq % 3) || ' critical' ELSE '' END AS estimated_impact FROM subject""")
def _(b):
    planned = plan_signals(b)
    return remediation.plans(planned, remediation.plan_steps(planned)).select("plan_id", "steps", "estimated_impact")


@case("rollback_order", """
SELECT signal_id, -step_order AS undo_order, action AS original_action, rollback_action FROM step WHERE is_reversible""", PLAN)
def _(b):
    return remediation.rollback_steps(remediation.plan_steps(plan_signals(b))).select(
        "signal_id", "undo_order", "original_action", "rollback_action"
    )


LEDGER = {**PLAN, "ledger": """
SELECT signal_id, CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN k % 7 = 0 THEN n - 1 ELSE n END AS steps_completed, CASE WHEN k % 7 = 0 THEN n END AS failed_step
FROM (SELECT signal_id, max(substr(entity_id, 2))::BIGINT AS k, count(*) AS n FROM step GROUP BY 1)"""}


@case("execution_ledger_unfinished", """
SELECT 'S/' || id AS signal_id, CASE WHEN ingest_seq % 2 = 0 THEN 'not_run' WHEN ingest_seq % 5 = 0 THEN 'running' ELSE 'completed' END AS status,
 CASE WHEN ingest_seq % 2 = 0 THEN 0 ELSE 1 END AS steps_completed, NULL::BIGINT AS failed_step FROM subject""")
def _(b):
    """Odd subjects report their first step only, even ones nothing."""
    steps = remediation.plan_steps(plan_signals(b))
    sequence = b.estate.subject.select(F.concat(F.lit("S/"), "id").alias("signal_id"), "ingest_seq")
    first = (
        steps.join(sequence, "signal_id")
        .where((F.col("ingest_seq") % 2 == 1) & (F.col("step_order") == 1))
        .select("signal_id", "step_order", F.lit(True).alias("ok"))
    )
    return remediation.execution_ledger(steps, first).withColumn("failed_step", F.col("failed_step").cast("bigint"))


@case("execution_ledger", "SELECT signal_id, status, steps_completed, failed_step FROM ledger", LEDGER)
def _(b):
    steps = remediation.plan_steps(plan_signals(b))
    return remediation.execution_ledger(steps, results(b, steps))


@case("steps_to_undo", """
SELECT s.signal_id, -s.step_order AS undo_order, s.rollback_action FROM step s JOIN ledger l ON l.signal_id = s.signal_id
WHERE l.status = 'failed' AND s.step_order < l.failed_step AND s.is_reversible""", LEDGER)
def _(b):
    steps = remediation.plan_steps(plan_signals(b))
    ledger = remediation.execution_ledger(steps, results(b, steps))
    return remediation.steps_to_undo(steps, ledger).select("signal_id", "undo_order", "rollback_action")


@case("approval_gate", """
SELECT 'S/' || id AS signal_id, CASE WHEN ingest_seq % 11 = 0 THEN 'conflict'
 WHEN ingest_seq % 5 < 3 AND ingest_seq % 2 <> 0 THEN 'blocked' ELSE 'allowed' END AS decision FROM subject""")
def _(b):
    planned = plan_signals(b)
    number = F.substr("entity_id", F.lit(2)).cast("bigint")
    return remediation.approval_gate(planned, planned.where(number % 2 == 0), planned.where(number % 11 == 0))


@case("audit_of_signal", "SELECT 'S/' || subject_id AS signal_id, id FROM assignment WHERE subject_id = 'S7'")
def _(b):
    audit = b.estate.assignment.select(F.concat(F.lit("S/"), "subject_id").alias("signal_id"), "id")
    return remediation.audit_of(audit, "S/S7")
