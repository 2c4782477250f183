from helpers import rows, subject
from pyspark.sql import functions as F

from gatewarden.operators import drift, learning, remediation, signals


def finding(i, s, source, action, confidence=0.93):
    return {
        "id": i, "subject_id": s, "source": source, "confidence": confidence, "end_result": "r",
        "steps": [{"action": action, "resource": "x", "description": "d"}],
    }


def test_finding_classes_first_match_wins(spark):
    cases = [
        ("trading", "AI Agent Chinese Wall Breach", 15), ("trading", "AI Agent Cross-Barrier Access", 10),
        ("trading", "Cross-Desk Position Access", 13), ("healthcare", "Excessive Record Access", 6),
        ("healthcare", "PHI Access Without MFA", 8), ("okta", "api.token.stale", 10), ("okta", "account.dormant", 4),
        ("okta", "excessive.superadmins", 7), ("netsuite", "Vendors", 1), ("healthcare", "Other", 15),
    ]
    df = spark.createDataFrame([(s, a) for s, a, _ in cases], "s string, a string")
    got = [r[0] for r in df.select(signals.classify_finding(F.col("s"), F.col("a"))[1]).collect()]
    assert got == [c for _, _, c in cases]


def test_findings_are_unique_by_name_and_rule(estate_of):
    e = estate_of(
        subject=[subject("a", display_name="Ann"), subject("b", display_name="Ann"), subject("c", display_name="Cy")],
        escalation_path=[
            finding("1", "a", "netsuite", "Customers", 0.92), finding("2", "a", "netsuite", "Customers", 0.91),
            finding("3", "b", "netsuite", "Customers", 0.99), finding("4", "c", "okta", "account.dormant.for.a.long.time", 0.97),
            finding("5", "gone", "okta", "x"), finding("6", "c", "aws_iam", "x"),
        ],
    )
    got = rows(signals.signals_from_findings(e), "subject", "rule", "severity", "violation_class")
    assert got == [("Ann", "NETSUITE-Customers", "high", 1), ("Cy", "OKTA-account.dormant.for.", "critical", 4)]


def test_severities(spark):
    df = spark.createDataFrame(
        [(0.95, 1, 0), (0.95, 0, 0), (0.5, 0, 11), (0.7, 0, 0), (0.6, 0, 10)], "c double, n int, r int"
    )
    got = [r[0] for r in df.select(signals.model_severity(F.col("c"), F.col("n"), F.col("r"))).collect()]
    assert got == ["critical", "high", "high", "medium", "low"]


def test_best_signal_on_ties_is_the_first(spark):
    df = spark.createDataFrame(
        [("m", "e", 0.5, 3, "c"), ("m", "e", 0.9, 2, "b"), ("m", "e", 0.9, 1, "a")],
        "model_id string, entity_id string, confidence double, seq int, tag string",
    )
    assert rows(signals.best_per_entity(df), "tag") == [("a",)]


def test_plan_for_unnamed_permission_and_undo(spark):
    given = spark.createDataFrame(
        [("s", "e", "okta", "revoke_permission", "M", None), ("t", "f", "okta", "flag_for_review", "M", None)],
        "signal_id string, entity_id string, source string, action string, model_id string, severity string",
    )
    steps = remediation.plan_steps(given)
    first = steps.where("signal_id = 's'").first()
    assert first["parameters"] == '{"permission_id":"M"}' and first["is_reversible"]
    ticket = steps.where("signal_id = 't'").first()
    assert '"priority":"medium"' in ticket["parameters"] and ticket["target_system"] == remediation.REVIEW_SYSTEM


def test_permission_changes_both_ways(spark):
    pair = "subject_id string, permission_id string"
    before = spark.createDataFrame([("a", "p"), ("a", "q")], pair)
    after = spark.createDataFrame([("a", "q"), ("b", "p")], pair)
    got = rows(drift.permission_changes(before, after), "subject_id", "permission_id", "change")
    assert got == [("a", "p", "removed"), ("b", "p", "added")]


def test_label_merge_order(spark):
    files = spark.createDataFrame(
        [("bootstrap", 0, "a", 3, 1, 0.5), ("bootstrap", 1, "a", 3, 0, 0.9), ("human", 0, "a", 4, 1, None),
         ("implicit", 0, "a", 4, 0, None), ("human", 0, "b", 3, 1, None)],
        "source string, pos int, subject_id string, violation_class int, label int, confidence double",
    )
    got = rows(learning.merge_labels(files), "subject_id", "violation_class", "label", "weight")
    assert got == [("a", 3, 0, 0.54), ("a", 4, 0, 0.8), ("b", 3, 1, 1.0)]


def test_injected_violations_are_found(spark, estate_of):
    from gatewarden.operators import injection, labels
    from helpers import permission

    e = estate_of(
        subject=[subject(f"s{i:03d}", display_name=f"n{i}") for i in range(300)], permission=[permission("p")]
    )
    injected, truth = injection.inject_violations(e, "2002-01-01 00:00:00", seed=3)
    assert truth.count() > 100
    inputs = labels.RuleInputs(injected, None, None, None, "2002-01-01 00:00:00")
    found = labels.break_glass_labels(inputs).unionByName(labels.toxic_security_finance_labels(inputs))
    found = found.unionByName(labels.open_trust_labels(inputs)).unionByName(labels.escalation_labels(inputs))
    wanted = truth.where("violation_class in (2, 7, 13, 14) and (violation_class <> 2 or confidence > 0)")
    got = {r["violation_class"]: r["recall"] for r in learning.rule_recall(found, wanted).collect()}
    assert got == {2: 1.0, 7: 1.0, 13: 1.0, 14: 1.0}
