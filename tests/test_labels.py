from datetime import datetime

from helpers import grant, permission, rows, subject

from gatewarden.operators import access, escalation, features, identity, labels, sod

AS_OF = "2002-01-01 00:00:00"


def inputs(spark, e, feature_rows=None):
    table = None
    if feature_rows is not None:
        names = sorted({k for r in feature_rows for k in r})
        table = spark.createDataFrame([tuple(r.get(n) for n in names) for r in feature_rows], names)
    return labels.RuleInputs(e, table, identity.correlated_members(e.subject), sod.pair_table(spark), AS_OF)


def test_excessive_privilege_tiers(spark, estate_of):
    e = estate_of(subject=[subject(s) for s in "abcd"])
    facts = [
        {"subject_id": s, "type": t, "source": "okta", "permission_to_peer_median_ratio": r, "total_permissions": 9}
        for s, t, r in (("a", "human", 3.5), ("b", "human", 3.0), ("c", "human", 2.0), ("d", "group", 9.0))
    ]
    got = rows(labels.excessive_privilege_labels(inputs(spark, e, facts)), "subject_id", "rule_id", "confidence")
    assert got == [("a", "EP-R1-HIGH", 0.8), ("b", "EP-R1-MED", 0.6)]


def test_mfa_unknown_is_no_hit(spark, estate_of):
    e = estate_of(
        subject=[
            subject("a", mfa_enabled=None), subject("b", mfa_enabled=False), subject("c", mfa_enabled=True),
            subject("d", mfa_enabled=False, status="inactive"), subject("p", mfa_enabled=False, status="inactive"),
        ]
    )
    facts = [{"subject_id": s, "privileged_permissions": int(s == "p")} for s in "abcdp"]
    got = rows(labels.missing_mfa_labels(inputs(spark, e, facts)), "subject_id", "rule_id")
    assert got == [("b", "MFA-R1-ACTIVE"), ("p", "MFA-R1-PRIV")]


def test_break_glass_needs_two_whole_days(spark, estate_of):
    e = estate_of(
        subject=[subject("a"), subject("b"), subject("g", type="group")],
        permission=[permission("p", name="Fire-call FIRECALL"), permission("t", tags=["sos_admin"]), permission("n")],
        assignment=[
            grant("a", "p", granted_at=datetime(2001, 12, 31)), grant("b", "p", granted_at=datetime(2001, 12, 30)),
            grant("a", "t", granted_at=datetime(2001, 1, 1)), grant("a", "n", granted_at=datetime(2001, 1, 1)),
            grant("g", "p", granted_at=datetime(2001, 1, 1)), grant("b", "t"),
        ],
    )
    got = labels.break_glass_labels(inputs(spark, e))
    assert rows(got, "subject_id") == [("a",), ("b",)]


def test_justification_rules_per_assignment(spark, estate_of):
    e = estate_of(
        subject=[subject("a"), subject("o", source="okta")],
        permission=[permission("p", is_privileged=True), permission("q")],
        assignment=[
            grant("a", "p", granted_by="x"), grant("a", "p", n=1), grant("a", "p", n=2, justification="yes", granted_by="unknown"),
            grant("a", "q", granted_by="system"), grant("o", "p"),
        ],
    )
    given = inputs(spark, e)
    assert len(rows(labels.unjustified_labels(given), "subject_id")) == 2
    assert len(rows(labels.unknown_grantor_labels(given), "subject_id")) == 2


def test_config_change_and_admin_groups(spark, estate_of):
    e = estate_of(
        subject=[subject("a"), subject("b"), subject("c")],
        permission=[
            permission("p", ["iam:PutRolePolicy"]), permission("k", permission_keys=["ADMI_SETUP"]),
            permission("grp", type="group", name="Platform team"),
        ],
        assignment=[grant("a", "p"), grant("b", "p"), grant("b", "grp"), grant("c", "k")],
    )
    assert rows(labels.config_change_labels(inputs(spark, e)), "subject_id") == [("a",), ("c",)]


def test_escalation_wildcards_and_strict(spark, estate_of):
    e = estate_of(
        subject=[subject("a"), subject("b"), subject("c")],
        permission=[
            permission("star", ["iam:*"]), permission("sts", ["sts:AssumeRole"]), permission("pass", ["iam:PassRole"]),
            permission("fn", ["lambda:CreateFunction"]), permission("all", ["*"]),
        ],
        assignment=[grant("a", "star"), grant("a", "sts"), grant("b", "pass"), grant("b", "fn"), grant("c", "all")],
    )
    wide = escalation.detect_escalation_paths(e)
    assert rows(wide.where("subject_id = 'a'"), "id") == [("a#0",), ("a#1",), ("a#2",), ("a#5",), ("a#6",)]
    assert wide.where("subject_id = 'c'").count() == 7
    strict = escalation.detect_escalation_paths(e, wildcards=False)
    assert rows(strict, "id") == [("b#3",)]
    steps = strict.first()["steps"]
    assert [s["action"] for s in steps] == ["iam:PassRole", "lambda:CreateFunction"]


def test_stored_estate_gives_equal_results(spark, estate_of):
    from gatewarden.sources.tables import stored

    e = estate_of(
        subject=[subject("a", manager_id="b"), subject("b", email="m"), subject("g", type="group")],
        permission=[permission("p", ["x:y", "z"], is_privileged=True), permission("q")],
        assignment=[grant("a", "p"), grant("a", "p", n=1), grant("g", "p"), grant("b", "gone"), grant("b", "q")],
    )
    kept = stored(e)
    assert rows(access.held(kept, "name"), "subject_id", "name") == rows(access.held(e, "name"), "subject_id", "name")
    settings = features.FeatureSettings(AS_OF, with_betweenness=True)
    pairs = sod.pair_table(spark)
    one = features.subject_features(e, settings, identity.correlated_members(e.subject), pairs)
    two = features.subject_features(kept, settings, identity.correlated_members(kept.subject), pairs)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    group = {r["subject_id"]: r for r in one.collect()}["g"]
    assert group["permission_to_peer_median_ratio"] == 1.0 and group["peer_group_cosine_similarity"] == 1.0
    assert features.flat_vectors(one).first()["features"].size == 34
