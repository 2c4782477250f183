import json
import operator
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from gatewarden.operators import policies as pol, predicates, suggestions
from verification import QUERIES

VALUES = [None, 0, 5, 5.0, "5", "human", True, False]
THRESHOLDS = [None, 5, 4.5, "human", "5", True, [5, "human"], [None], [1], "a human here", []]
PYTHON = {
    "gt": operator.gt, "lt": operator.lt, "gte": operator.ge, "lte": operator.le, "eq": operator.eq,
    "neq": operator.ne, "in": lambda a, b: a in b, "not_in": lambda a, b: a not in b,
}


def expected(value, op, threshold):
    try:
        return bool(PYTHON[op](value, threshold))
    except TypeError:
        return False


def test_condition_truth_table(spark):
    from gatewarden.plans.durable import materialize

    kinds = {str: "text", bool: "boolean", int: "number", float: "number", type(None): "null"}
    cases = []
    for v in VALUES:
        number = float(v) if isinstance(v, (bool, int, float)) else None
        text = v if isinstance(v, str) else None
        for t in THRESHOLDS:
            for op in PYTHON:
                cases.append((len(cases), kinds[type(v)], number, text, op, json.dumps(t), expected(v, op, t)))
    table = spark.createDataFrame(
        cases, "i int, kind string, number double, text string, op string, threshold string, want boolean"
    )
    parsed = materialize(
        table.select("*", F.struct("kind", "number", "text").alias("value"), pol.parsed_threshold(F.col("threshold")).alias("t")),
        "cases",
    )
    wrong = parsed.where(pol.condition_holds(F.col("value"), F.col("op"), F.col("t")) != F.col("want"))
    assert wrong.select("kind", "number", "text", "op", "threshold", "want").collect() == []


def test_typed_features(spark):
    df = spark.createDataFrame([(1, 2.5, "x", True, None)], "i int, d double, s string, b boolean, n int")
    got = df.select(*[pol.typed(F.col(c), t).alias(c) for c, t in df.dtypes]).first()
    assert [got[c]["kind"] for c in "idsbn"] == ["number", "number", "text", "boolean", "null"]
    assert got["b"]["number"] == 1.0 and got["s"]["text"] == "x"


def tables(spark, policies, rules, conditions):
    base = {
        "customer_id": "c", "name": "n", "category": "zero_trust", "status": "active", "action": "alert",
        "severity": "high", "base_confidence": 0.5, "scope_sources": [], "scope_types": [], "scope_departments": [],
        "privileged_only": False, "approvals": 0, "graduation_threshold": 10, "true_positives": 0,
        "false_positives": 0, "true_negatives": 0, "false_negatives": 0,
    }
    names = [f.strip().split(" ")[0] for f in pol.POLICY_COLUMNS.replace("map<string,string>", "map").split(",")]
    rows_ = [tuple({**base, **p}.get(n) for n in names) for p in policies]
    return (
        spark.createDataFrame(rows_, pol.POLICY_COLUMNS),
        spark.createDataFrame(rules, pol.RULE_COLUMNS),
        spark.createDataFrame(conditions, pol.CONDITION_COLUMNS),
    )


def test_confidence_folds_in_rule_order(spark):
    p, r, c = tables(
        spark,
        [{"id": "p", "base_confidence": 0.8}, {"id": "none"}, {"id": "off", "status": "paused"},
         {"id": "okta", "scope_sources": ["okta"]}, {"id": "priv", "privileged_only": True}],
        [("p", 0, 0.5), ("p", 1, -0.3), ("p", 2, 0.1), ("off", 0, 0.0), ("okta", 0, 0.0), ("priv", 0, 0.0)],
        [("p", 0, 0, "n", "gt", "1"), ("p", 1, 0, "n", "gt", "1"), ("p", 2, 0, "n", "gt", "100"),
         ("off", 0, 0, "n", "gt", "1"), ("okta", 0, 0, "n", "gt", "1"), ("priv", 0, 0, "missing", "neq", "1")],
    )
    subjects = spark.createDataFrame(
        [("s", "aws_iam", "human", None, False), ("t", "okta", "human", "D", True), ("quiet", "okta", "human", None, False)],
        "subject_id string, source string, type string, department string, has_privileged boolean",
    ).withColumn("attributes", F.create_map().cast("map<string,string>"))
    features = spark.createDataFrame([("s", 5), ("t", 7)], "subject_id string, n int")
    got = pol.evaluate_policies(subjects, pol.feature_values(features), p, r, c, "c").collect()
    found = {(x["policy_id"], x["subject_id"]): x for x in got}
    # 0.8 + 0.5 is cut to 1.0 before 0.3 is taken off.
    assert abs(found[("p", "s")]["confidence"] - 0.7) < 1e-9
    assert found[("p", "s")]["matched_rules"] == [0, 1]
    assert found[("p", "s")]["feature_snapshot"] == {"n": "5"}
    assert set(found) == {("p", "s"), ("p", "t"), ("okta", "t"), ("priv", "t")}


def test_custom_filter(spark):
    p, r, c = tables(
        spark, [{"id": "p", "custom_filter": {"team": "x"}}], [("p", 0, 0.0)], [("p", 0, 0, "n", "neq", "9")]
    )
    subjects = spark.createDataFrame(
        [("a", {"team": "x"}), ("b", {"team": "y"}), ("c", {})], "subject_id string, attributes map<string,string>"
    ).select("*", F.lit("okta").alias("source"), F.lit("human").alias("type"), F.lit(None).cast("string").alias("department"), F.lit(False).alias("has_privileged"))
    features = spark.createDataFrame([("a", 1)], "subject_id string, n int")
    got = pol.evaluate_policies(subjects, pol.feature_values(features), p, r, c, "c")
    assert rows(got, "subject_id") == [("a",)]


def test_lifecycle_transitions(spark):
    p, r, c = tables(
        spark,
        [{"id": "rules", "status": "suggested"}, {"id": "bare", "status": "suggested"}, {"id": "grad", "approvals": 9, "status": "paused"}],
        [("rules", 0, 0.0), ("grad", 0, 0.0)], [("rules", 0, 0, "n", "gt", "1")],
    )
    events = [
        ("rules", 1, "approve", "ann", None, "escalate", "critical"), ("rules", 2, "approve", "bob", None, None, None),
        ("rules", 3, "pause", "ann", None, None, None), ("rules", 4, "approve", "eve", None, None, None),
        ("bare", 1, "pause", "x", None, None, None), ("bare", 2, "approve", "x", None, None, None),
        ("grad", 1, "graduate", "x", None, None, None), ("grad", 2, "approve", "x", None, None, None),
        ("grad", 3, "graduate", "x", None, None, None),
    ]
    table = spark.createDataFrame(
        events, "policy_id string, seq int, kind string, actor string, reason string, action_override string, severity_override string"
    ).withColumn("at", F.to_timestamp(F.lit("2001-01-01")))
    got = {x["id"]: x for x in pol.lifecycle(p, r, table).collect()}
    assert (got["rules"]["status"], got["rules"]["approvals"], got["rules"]["action"], got["rules"]["rejected_events"]) == ("active", 2, "escalate", 1)
    assert got["rules"]["approved_by"] == "eve"
    assert (got["bare"]["status"], got["bare"]["rejected_events"]) == ("approved", 1)
    assert (got["grad"]["status"], got["grad"]["approvals"], got["grad"]["rejected_events"]) == ("graduated", 10, 1)


def test_similarity_of_feature_sets(spark):
    p, r, c = tables(
        spark, [{"id": x} for x in "abcd"] + [{"id": "other", "category": "custom"}], [],
        [("a", 0, 0, "x", "gt", "1"), ("a", 0, 1, "y", "gt", "1"), ("b", 0, 0, "x", "lt", "1"), ("b", 1, 0, "x", "lt", "2"),
         ("c", 0, 0, "z", "gt", "1"), ("other", 0, 0, "x", "gt", "1")],
    )
    pairs, members = pol.similar_policies(p, c)
    assert rows(pol.similar_to(p.where("id = 'a'"), pairs, members), "similar_id", "similarity") == [("b", 0.5)]


def test_similar_sets_lose_no_pair(spark):
    draw = random.Random(3)
    named = {f"q{i}": set(draw.sample("abcdefgh", draw.randint(1, 6))) for i in range(70)}
    p, _, c = tables(
        spark, [{"id": i, "category": "zero_trust" if int(i[1:]) % 3 else "custom"} for i in named], [],
        [(i, 0, j, f, "gt", "1") for i, fs in named.items() for j, f in enumerate(sorted(fs))],
    )
    pairs, members = pol.similar_policies(p, c)
    got = set(rows(pol.similar_to(p, pairs, members), "policy_id", "similar_id"))
    kind = lambda i: int(i[1:]) % 3 == 0
    want = {
        (a, b) for a in named for b in named
        if a != b and kind(a) == kind(b) and 2 * len(named[a] & named[b]) >= len(named[a] | named[b])
    }
    assert got == want
    assert pairs.count() <= len({(kind(i), frozenset(s)) for i, s in named.items()}) ** 2 / 2


def test_query_names_what_is_like_every_policy(spark, tmp_path):
    """The rows of the query give back every pair of alike policies, and each policy's number of them."""
    spark.range(1, 190).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["similar_policies"](spark, str(tmp_path)).collect()
    mask = {f"Q{i}": i % 32 for i in range(1, 190) if i % 5 and i % 32}
    want = {
        (a, b) for a, m in mask.items() for b, n in mask.items()
        if a != b and m % 2 == n % 2 and 2 * (m & n).bit_count() >= (m | n).bit_count()
    }
    holders = {}
    for x in got:
        holders.setdefault((x["category"], x["features"]), set()).add(x["policy_id"])
    pairs = {(x["policy_id"], other) for x in got for other in holders[x["category"], x["other"]]}
    assert {p for p, _ in pairs} == set(mask)
    assert {(a, b) for a, b in pairs if a != b} == want
    assert sum(x["links"] for x in got) == len(want)


def test_links_of_a_set_that_nobody_shares(spark):
    p, r, c = tables(
        spark, [{"id": x} for x in "abcd"] + [{"id": "other", "category": "custom"}], [],
        [("a", 0, 0, "x", "gt", "1"), ("a", 0, 1, "y", "gt", "1"), ("b", 0, 0, "x", "lt", "1"), ("d", 0, 0, "x", "lt", "1"),
         ("c", 0, 0, "z", "gt", "1"), ("other", 0, 0, "x", "gt", "1")],
    )
    got = pol.policy_links(*pol.similar_policies(p, c))
    assert sorted((x["policy_id"], tuple(x["other"]), x["similarity"], x["links"]) for x in got.collect()) == [
        ("a", ("x",), 0.5, 2), ("a", ("x", "y"), 1.0, 0), ("b", ("x",), 1.0, 1), ("b", ("x", "y"), 0.5, 1),
        ("c", ("z",), 1.0, 0), ("d", ("x",), 1.0, 1), ("d", ("x", "y"), 0.5, 1), ("other", ("x",), 1.0, 0),
    ]


def naive_evaluation(subjects, values, policies, rules, conditions):
    """Every subject against every policy."""
    nested = pol.nested_rules(policies, rules, conditions).withColumnRenamed("id", "policy_id")
    met = subjects.join(values, "subject_id", "left").crossJoin(nested).where(pol.in_scope(F.col("attributes")))
    fired = F.filter("rules", lambda r: pol.rule_fires(F.col("values"), r))
    return met.withColumn("fired", fired).where(F.size("fired") > 0).select(
        "policy_id", "subject_id", F.transform("fired", lambda r: r["rule_no"]).alias("matched_rules")
    )


def test_index_finds_what_all_pairs_find(spark):
    draw = random.Random(8)
    names = ["n", "m", "k", "flag", "absent"]
    people = [
        (f"s{i}", draw.choice(["okta", "entra", None]), draw.choice(["human", "group"]), draw.choice(["x", "y", None]), draw.random() < 0.5,
         {"segment": draw.choice("ab")} if draw.random() < 0.7 else None)
        for i in range(60)
    ]
    subjects = spark.createDataFrame(
        people, "subject_id string, source string, type string, department string, has_privileged boolean, attributes map<string,string>"
    )
    facts = [
        (f"s{i}", draw.choice([None, 0, 1, 2, 3, 50]), draw.choice([0.0, -0.0, 1.5, None, float("nan")]), draw.choice(["a", "b", "1", None]), draw.choice([True, False, None]))
        for i in range(55)
    ]
    values = pol.feature_values(spark.createDataFrame(facts, "subject_id string, n int, m double, k string, flag boolean"))
    thresholds = [0, 1, 2, 1.5, "a", "1", None, True, [1, 2], ["a", None], [], "abc", -0.0]
    scope = lambda options: draw.choice([None, [], options, options[:1]])
    policies, rules, conditions = [], [], []
    for i in range(60):
        policies.append({"id": f"p{i}", "scope_sources": scope(["okta", "entra"]), "scope_types": scope(["human"]), "scope_departments": scope(["x", "y"]),
                         "privileged_only": draw.choice([None, True, False]), "custom_filter": draw.choice([None, {"segment": "a"}, {"segment": None}])})
        for r in range(draw.randint(1, 3)):
            rules.append((f"p{i}", r, 0.1))
            for j in range(draw.randint(1, 3)):
                op = draw.choice(["gt", "gte", "lt", "lte", "eq", "neq", "in", "not_in"])
                conditions.append((f"p{i}", r, j, draw.choice(names), op, json.dumps(draw.choice(thresholds))))
    p, r, c = tables(spark, policies, rules, conditions)
    got = pol.evaluate_policies(subjects, values, p, r, c, "c").select("policy_id", "subject_id", "matched_rules")
    want = naive_evaluation(subjects, values, p, r, c)
    key = lambda x: (x[0], x[1], tuple(x[2]))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) != []


def test_candidates_stay_near_the_matches(spark):
    """1,000 policies of scope "everybody" ask for one rare value each; pairs would be 200,000."""
    subjects = spark.createDataFrame(
        [(f"s{i}", "okta", "human", "x", False) for i in range(200)], "subject_id string, source string, type string, department string, has_privileged boolean"
    ).withColumn("attributes", F.create_map().cast("map<string,string>"))
    values = pol.feature_values(spark.createDataFrame([(f"s{i}", i, f"k{i}") for i in range(200)], "subject_id string, n int, k string"))
    p, r, c = tables(
        spark, [{"id": f"p{i}"} for i in range(1000)], [(f"p{i}", 0, 0.0) for i in range(1000)],
        [(f"p{i}", 0, 0, "n", "gte", "0") for i in range(1000)]
        + [(f"p{i}", 0, 1, *(("k", "eq", f'"k{i % 200}"') if i % 2 else ("n", "gt", str(195 + i % 4)))) for i in range(1000)],
    )
    nested = pol.nested_rules(p, r, c)
    parsed = nested.select(F.col("id").alias("policy_id"), F.explode("rules").alias("rule")).select("policy_id", "rule.rule_no", F.inline("rule.conditions"))
    found = predicates.candidates(subjects.join(values, "subject_id"), nested, parsed)
    matches = pol.evaluate_policies(subjects, values, p, r, c, "c").count()
    assert found.count() == matches == 500 + 250 * (4 + 2)


def test_native_and_general_conditions_agree(spark):
    features = spark.createDataFrame([("s", 5, None), ("t", None, "k")], "subject_id string, n int, k string")
    for name in ("n", "k", "absent"):
        for op, threshold in (("gt", 3), ("eq", 5), ("neq", 5), ("eq", "k"), ("in", [5]), ("not_in", [5]), ("eq", None)):
            if name == "n" and threshold == "k" or name == "k" and not isinstance(threshold, str) and threshold is not None:
                continue
            native = [x[0] for x in features.select(suggestions.native_condition(features, name, op, threshold)).collect()]
            column = (
                pol.typed(F.col(name), dict(features.dtypes)[name]) if name != "absent"
                else pol.typed(F.lit(None).cast("string"), "string")
            )
            general = [
                x[0] for x in features.select(
                    pol.condition_holds(column, F.lit(op), pol.parsed_threshold(F.lit(json.dumps(threshold))))
                ).collect()
            ]
            assert native == general, (name, op, threshold)


def test_template_suggestion_priority(spark):
    rows_ = [("a", "human", "okta", 100, 1, 0.0), ("b", "human", "okta", 1, 1, 1.0), ("c", "group", "netsuite", 1, 0, 0.5), ("d", "human", "okta", 1, 0, 1.0)]
    features = spark.createDataFrame(
        rows_, "subject_id string, type string, source string, days_since_last_activity int, privileged_permissions int, mfa_usage_rate double"
    )
    for name, value in {
        "department": "unknown", "total_permissions": 1, "permission_to_peer_median_ratio": 1.0, "distinct_source_ips_30d": 0,
        "permissions_added_30d": 0, "permissions_removed_30d": 0, "source_system_count": 1, "sod_pair_membership_count": 0,
        "betweenness_centrality": 0.0, "cross_system_consistency_score": 1.0, "usage_ratio": 1.0, "trust_policy_open": False,
    }.items():
        features = features.withColumn(name, F.lit(value))
    got = {x["name"]: x for x in suggestions.template_suggestions(features).collect()}
    assert set(got) == {"Dormant privileged access — 90 day threshold", "Missing MFA on privileged human accounts"}
    assert abs(got["Missing MFA on privileged human accounts"]["priority"] - (0.3 + 0.25 * 0.7 + 0.2)) < 1e-9
    assert got["Dormant privileged access — 90 day threshold"]["sample_affected"] == ["a"]
    assert got["Dormant privileged access — 90 day threshold"]["estimated_impact"] == "Would flag 1 identities"


@pytest.mark.parametrize("bad", [(0, 10), (1, 0), (1, 201)])
def test_page_limits(spark, bad):
    from gatewarden.operators.signals import page

    with pytest.raises(ValueError):
        page(spark.range(3), *bad)
