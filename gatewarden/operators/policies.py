"""Customer policies: scope, conditions, evaluation, lifecycle, feedback, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewarden.functions import fixed_values as fixed
from gatewarden.functions.scalars import clamp, ratio_or_zero
from gatewarden.operators import predicates
from gatewarden.plans.durable import materialize
from gatewarden.plans.joins import skew_join
from gatewarden.plans.tables import literal_table

STRINGS = "array<string>"

POLICY_COLUMNS = (
    "id string, customer_id string, name string, category string, status string, action string, "
    "severity string, base_confidence double, suggested_at timestamp, scope_sources array<string>, "
    "scope_types array<string>, scope_departments array<string>, privileged_only boolean, "
    "custom_filter map<string,string>, approvals int, graduation_threshold int, "
    "true_positives int, false_positives int, true_negatives int, false_negatives int"
)
# A threshold is JSON: a number, text, boolean, null or a list of these.
CONDITION_COLUMNS = (
    "policy_id string, rule_no int, condition_no int, feature_name string, operator string, threshold string"
)
RULE_COLUMNS = "policy_id string, rule_no int, confidence_boost double"


def _scalar(kind: Column, number: Column, text: Column) -> Column:
    return F.struct(
        kind.alias("kind"), number.cast("double").alias("number"), text.cast("string").alias("text")
    )


def typed(column: Column, dtype: str) -> Column:
    """A feature column as a typed scalar: kind (null, boolean, number, text), number, text."""
    if dtype == "string":
        kind, number = F.lit("text"), F.lit(None)
    elif dtype == "boolean":
        kind, number = F.lit("boolean"), column.cast("int")
    else:
        kind, number = F.lit("number"), column
    return _scalar(F.when(column.isNull(), "null").otherwise(kind), number, column)


def _typed_variant(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    kind = (
        F.when(shape.isNull() | (shape == "VOID"), "null")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "STRING", "text")
        .when(F.startswith(shape, F.lit("ARRAY")), "list")
        .otherwise("number")
    )
    number = F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean").cast("int")).when(
        kind == "number", F.try_variant_get(value, "$", "double")
    )
    return _scalar(kind, number, F.when(kind != "list", F.try_variant_get(value, "$", "string")))


def parsed_threshold(json: Column) -> Column:
    """A JSON threshold as a typed scalar plus its ``items`` when it is a list.

    Thresholds are parsed once per policy, not once per subject.
    """
    value = F.try_parse_json(F.coalesce(json, F.lit("null")))
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), _typed_variant)
    return F.struct(_typed_variant(value).alias("scalar"), items.alias("items"))


def _is_numeric(value: Column) -> Column:
    return value["kind"].isin("number", "boolean")


def _same(a: Column, b: Column) -> Column:
    """Equality of two typed scalars; NULL equals NULL, a number never equals a text."""
    return F.coalesce(
        F.when((a["kind"] == "null") & (b["kind"] == "null"), True)
        .when(_is_numeric(a) & _is_numeric(b), a["number"] == b["number"])
        .when((a["kind"] == "text") & (b["kind"] == "text"), a["text"] == b["text"])
        .otherwise(False),
        F.lit(False),
    )


def condition_holds(value: Column, operator: Column, threshold: Column) -> Column:
    """Does a condition hold? ``value`` is a typed scalar (NULL = unknown feature).

    Orderings of unlike kinds or with a missing side are false. ``neq`` and
    ``not_in`` are true for a missing feature; ``eq`` is true for a missing feature
    only when the threshold is null. ``in`` and ``not_in`` need a list, or a text
    to look for a text in; anything else makes both false.
    """
    missing = _scalar(F.lit("null"), F.lit(None), F.lit(None))
    v, t = F.coalesce(value, missing), threshold["scalar"]
    texts = (v["kind"] == "text") & (t["kind"] == "text")
    numbers = _is_numeric(v) & _is_numeric(t)

    def ordered(compare) -> Column:
        by_kind = F.when(numbers, compare(v["number"], t["number"])).when(
            texts, compare(v["text"], t["text"])
        )
        return F.coalesce(by_kind, F.lit(False))

    is_list = t["kind"] == "list"
    listed = F.coalesce(F.exists(threshold["items"], lambda i: _same(v, i)), F.lit(False))
    inside = F.when(is_list, listed).when(texts, F.contains(t["text"], v["text"])).otherwise(F.lit(False))
    return (
        F.when(operator == "gt", ordered(lambda x, y: x > y))
        .when(operator == "lt", ordered(lambda x, y: x < y))
        .when(operator == "gte", ordered(lambda x, y: x >= y))
        .when(operator == "lte", ordered(lambda x, y: x <= y))
        .when(operator == "eq", _same(v, t))
        .when(operator == "neq", ~_same(v, t))
        .when(operator == "in", inside)
        .when(operator == "not_in", (is_list | texts) & ~inside)
        .otherwise(F.lit(False))
    )


def feature_values(features: DataFrame, key: str = "subject_id") -> DataFrame:
    """(subject_id, values): the feature row as a map of typed scalars."""
    pairs = []
    for name, dtype in features.dtypes:
        if name != key:
            pairs += [F.lit(name), typed(F.col(name), dtype)]
    return features.select(key, F.create_map(*pairs).alias("values"))


def valid_policies(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by confidence range and severity vocabulary."""
    good = F.coalesce(
        F.col("base_confidence").between(0.0, 1.0) & F.col("severity").isin(*fixed.SEVERITIES), F.lit(False)
    )
    return policies.where(good), policies.where(~good)


def valid_rules(rules: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rules: boost within a half, at least one condition, known operators."""
    judged = conditions.groupBy("policy_id", "rule_no").agg(
        F.bool_and(F.col("operator").isin(*fixed.POLICY_OPERATORS)).alias("known")
    )
    joined = rules.join(judged, ["policy_id", "rule_no"], "left")
    good = F.coalesce(F.col("known") & F.col("confidence_boost").between(-0.5, 0.5), F.lit(False))
    return joined.where(good).drop("known"), joined.where(~good).drop("known")


def in_scope(attributes: Column | None = None) -> Column:
    """Does the subject row match the policy row's scope? Empty lists mean everybody.

    Expects subject columns source, type, department, has_privileged (and
    ``attributes``, a map) next to the policy's scope columns.
    """

    def listed(scope: str, column: str) -> Column:
        values = F.coalesce(F.col(scope), F.array().cast(STRINGS))
        return (F.size(values) == 0) | F.coalesce(F.array_contains(values, F.col(column)), F.lit(False))

    matches = (
        listed("scope_sources", "source")
        & listed("scope_types", "type")
        & listed("scope_departments", "department")
        & (~F.coalesce("privileged_only", F.lit(False)) | F.coalesce("has_privileged", F.lit(False)))
    )
    if attributes is None:
        return matches
    wanted = F.coalesce("custom_filter", F.create_map().cast("map<string,string>"))
    return matches & F.forall(
        F.map_entries(wanted), lambda e: F.equal_null(F.try_element_at(attributes, e["key"]), e["value"])
    )


def nested_rules(policies: DataFrame, rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """Policies with their rules as one array column (ordered); without rules: dropped.

    A policy has a handful of rules, written by people.
    """
    per_rule = conditions.groupBy("policy_id", "rule_no").agg(
        F.array_sort(
            F.collect_list(F.struct("condition_no", "feature_name", "operator", "threshold"))
        ).alias("__raw")
    ).select(
        "policy_id",
        "rule_no",
        F.transform(
            "__raw",
            lambda c: F.struct(
                c["feature_name"].alias("feature_name"),
                c["operator"].alias("operator"),
                parsed_threshold(c["threshold"]).alias("threshold"),
            ),
        ).alias("conditions"),
    )
    per_policy = (
        rules.join(per_rule, ["policy_id", "rule_no"])
        .groupBy("policy_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("rule_no", "confidence_boost", "conditions"))).alias("rules")
        )
    )
    return policies.join(per_policy.withColumnRenamed("policy_id", "id"), "id")


def rule_fires(values: Column, rule: Column) -> Column:
    """All conditions of a rule hold; an unknown feature is a missing value.

    The value is looked up once per condition, before the condition is judged.
    """
    looked_up = F.transform(
        rule["conditions"],
        lambda c: F.struct(
            F.try_element_at(values, c["feature_name"]).alias("value"),
            c["operator"].alias("operator"),
            c["threshold"].alias("threshold"),
        ),
    )
    return F.forall(looked_up, lambda c: condition_holds(c["value"], c["operator"], c["threshold"]))


def evaluate_policies(
    subjects: DataFrame,
    values: DataFrame,
    policies: DataFrame,
    rules: DataFrame,
    conditions: DataFrame,
    customer_id: str,
) -> DataFrame:
    """Triggered (policy, subject) pairs of one customer's active policies.

    ``subjects`` has subject_id, source, type, department, has_privileged and a map
    ``attributes``; ``values`` is a :func:`feature_values` table. Subjects meet rules through the
    index of ``predicates``: only those that pass a rule's rarest predicate are candidates. What
    remains of scope and conditions is judged on the candidates; the rules that fire are gathered per
    policy and subject (a handful, people wrote them), and confidence folds over them in their order,
    clamped to [0, 1] at each step.
    """
    active = policies.where((F.col("customer_id") == customer_id) & (F.col("status") == "active"))
    nested = materialize(nested_rules(active, rules, conditions), "policies")
    single = nested.withColumnRenamed("id", "policy_id").withColumns(
        {
            "rule": F.explode("rules"),
            "names": F.array_distinct(
                F.flatten(F.transform("rules", lambda r: F.transform(r["conditions"], lambda c: c["feature_name"])))
            ),
        }
    ).drop("rules")
    judged = materialize(single.withColumn("rule_no", F.col("rule.rule_no")), "rules")
    parsed = judged.select("policy_id", "rule_no", F.inline("rule.conditions"))
    known = materialize(subjects.join(values, "subject_id", "left"), "known-subjects")
    met = predicates.candidates(known, nested, parsed)
    looked_up = skew_join(met, judged, ["policy_id", "rule_no"], spread_by=["subject_id"]).join(known, "subject_id")
    fired = looked_up.where(in_scope(F.col("attributes")) & rule_fires(F.col("values"), F.col("rule")))
    snapshot = F.map_from_arrays(
        "names", F.transform("names", lambda n: F.try_element_at(F.col("values"), n)["text"])
    )
    gathered = fired.groupBy("policy_id", "subject_id").agg(
        F.array_sort(F.collect_list(F.struct("rule_no", F.col("rule.confidence_boost").alias("boost")))).alias("fired"),
        F.first("base_confidence").alias("base_confidence"),
        F.first(snapshot).alias("feature_snapshot"),
        F.first("suggested_at").alias("policy_suggested_at"),
    )
    confidence = F.aggregate("fired", F.col("base_confidence"), lambda acc, r: clamp(acc + r["boost"], 0.0, 1.0))
    return gathered.select(
        "policy_id",
        "subject_id",
        confidence.alias("confidence"),
        F.transform("fired", lambda r: r["rule_no"]).alias("matched_rules"),
        "feature_snapshot",
        "policy_suggested_at",
    )


def list_policies(
    policies: DataFrame, customer_id: str | None = None, status: str | None = None, category: str | None = None
) -> DataFrame:
    """Policies that pass the filters, newest first."""
    out = policies
    for column, value in (("customer_id", customer_id), ("status", status), ("category", category)):
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    return out.orderBy(F.desc("suggested_at"), "id")


def template_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(policies, rules, conditions) of the best-practice templates."""
    import json

    policies = [
        (f"T{i:02d}", name, category, action, severity, confidence)
        for i, (name, category, action, severity, confidence, _) in enumerate(fixed.POLICY_TEMPLATES)
    ]
    rules = [(p[0], 0, 0.0) for p in policies]
    conditions = [
        (f"T{i:02d}", 0, j, feature, operator, json.dumps(threshold))
        for i, template in enumerate(fixed.POLICY_TEMPLATES)
        for j, (feature, operator, threshold) in enumerate(template[5])
    ]
    return (
        literal_table(
            spark,
            "id string, name string, category string, action string, severity string, base_confidence double",
            policies,
        ),
        literal_table(spark, RULE_COLUMNS, rules),
        literal_table(spark, CONDITION_COLUMNS, conditions),
    )


def lifecycle(policies: DataFrame, rules: DataFrame, events: DataFrame) -> DataFrame:
    """Policies after their decision events, applied in order.

    ``events``: policy_id, seq, kind (approve, dismiss, pause, archive, graduate),
    actor, reason, action_override, severity_override, at. Approving works from
    suggested or paused and makes a policy with rules active; pausing works on
    active policies; graduating needs enough approvals. Anything else is counted
    in ``rejected_events``. One policy's events are one reviewer's clicks, so they
    are folded as one array.
    """
    histories = events.groupBy(F.col("policy_id").alias("id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct("seq", "kind", "actor", "reason", "action_override", "severity_override", "at")
            )
        ).alias("history")
    )
    with_rules = rules.select(F.col("policy_id").alias("id")).distinct().withColumn("has_rules", F.lit(True))
    start = F.struct(
        F.col("status").alias("status"), F.col("action").alias("action"), F.col("severity").alias("severity"),
        F.coalesce("approvals", F.lit(0)).alias("approvals"),
        F.lit(None).cast("string").alias("approved_by"), F.lit(None).cast("timestamp").alias("approved_at"),
        F.lit(None).cast("string").alias("dismissed_reason"),
        F.lit(None).cast("timestamp").alias("dismissed_at"),
        F.lit(0).alias("rejected"),
    )
    has_rules = F.coalesce("has_rules", F.lit(False))
    threshold = F.coalesce("graduation_threshold", F.lit(10))

    def step(state: Column, event: Column) -> Column:
        kind = event["kind"]
        approve = (kind == "approve") & state["status"].isin("suggested", "paused")
        dismiss, archive = kind == "dismiss", kind == "archive"
        pause = (kind == "pause") & (state["status"] == "active")
        graduate = (kind == "graduate") & (state["approvals"] >= threshold)
        done = approve | dismiss | archive | pause | graduate
        return F.struct(
            F.when(approve, F.when(has_rules, "active").otherwise("approved"))
            .when(dismiss, "dismissed").when(pause, "paused").when(archive, "archived")
            .when(graduate, "graduated").otherwise(state["status"]).alias("status"),
            F.when(approve, F.coalesce(event["action_override"], state["action"]))
            .otherwise(state["action"]).alias("action"),
            F.when(approve, F.coalesce(event["severity_override"], state["severity"]))
            .otherwise(state["severity"]).alias("severity"),
            (state["approvals"] + F.when(approve, 1).otherwise(0)).alias("approvals"),
            F.when(approve, event["actor"]).otherwise(state["approved_by"]).alias("approved_by"),
            F.when(approve, event["at"]).otherwise(state["approved_at"]).alias("approved_at"),
            F.when(dismiss, event["reason"]).otherwise(state["dismissed_reason"]).alias("dismissed_reason"),
            F.when(dismiss, event["at"]).otherwise(state["dismissed_at"]).alias("dismissed_at"),
            (state["rejected"] + F.when(done, 0).otherwise(1)).alias("rejected"),
        )

    replaced = ("status", "action", "severity", "approvals")
    return (
        policies.join(histories, "id", "left")
        .join(with_rules, "id", "left")
        .withColumn(
            "state",
            F.when(F.col("history").isNull(), start).otherwise(F.aggregate("history", start, step)),
        )
        .select(
            *[F.col(f"state.{c}").alias(c) if c in replaced else F.col(c) for c in policies.columns],
            "state.approved_by", "state.approved_at", "state.dismissed_reason", "state.dismissed_at",
            F.col("state.rejected").alias("rejected_events"),
        )
    )


def feedback_counters(policies: DataFrame, feedback: DataFrame) -> DataFrame:
    """Policies with feedback added: verdict true_positive, false_positive or false_negative.

    Millions of verdicts on one policy are counted map-side.
    """
    counts = feedback.groupBy(F.col("policy_id").alias("id")).agg(
        *[
            F.count_if(F.col("verdict") == verdict).cast("int").alias(f"__{verdict}s")
            for verdict in ("true_positive", "false_positive", "false_negative")
        ]
    )
    out = policies.join(counts, "id", "left")
    for verdict in ("true_positives", "false_positives", "false_negatives"):
        out = out.withColumn(
            verdict, F.coalesce(verdict, F.lit(0)) + F.coalesce(f"__{verdict}", F.lit(0))
        )
    return out.select(*policies.columns)


def f1(precision: Column, recall: Column) -> Column:
    return ratio_or_zero(2 * precision * recall, precision + recall)


def policy_performance(policies: DataFrame) -> DataFrame:
    """Precision, recall, F1 and readiness to graduate, per policy."""
    tp, fp, fn = (F.coalesce(c, F.lit(0)) for c in ("true_positives", "false_positives", "false_negatives"))
    return (
        policies.withColumn("precision", ratio_or_zero(tp, tp + fp))
        .withColumn("recall", ratio_or_zero(tp, tp + fn))
        .select(
            F.col("id").alias("policy_id"), "name", "status", "true_positives", "false_positives",
            "true_negatives", "false_negatives", "precision", "recall",
            f1(F.col("precision"), F.col("recall")).alias("f1_score"),
            (tp + fp + F.coalesce("true_negatives", F.lit(0)) + fn).alias("total_feedback"),
            F.col("approvals").alias("cross_customer_approvals"),
            (F.col("approvals") >= F.col("graduation_threshold")).alias("ready_for_graduation"),
        )
    )


def graduation_candidates(policies: DataFrame) -> DataFrame:
    """Active policies with enough approvals across customers."""
    return policies.where(
        (F.col("status") == "active") & (F.col("approvals") >= F.col("graduation_threshold"))
    )


def similar_policies(policies: DataFrame, conditions: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): which sets of feature names are alike, and which policies have which set.

    Policies are alike when they share a category and the Jaccard index of their referenced feature names is
    ``least`` or more. ``members`` is (policy_id, category, set_id, features), ``pairs`` is (category, set_id,
    other_id, similarity) over the distinct sets, each pair once; policies of one set are alike by 1. So the
    output grows with the policies and their distinct sets, not with the pairs of policies.

    Sets of size s can only reach ``least`` if they share one of their s - ceil(least * s) + 1 rarest
    names (names in order of rarity), so only those are joined, and only for sizes within a factor of ``least``.
    """
    named = conditions.select(F.col("policy_id").alias("id"), "feature_name").distinct()
    # A person wrote the policy: its feature names are few.
    sets = named.groupBy("id").agg(F.array_sort(F.collect_set("feature_name")).alias("features"))
    set_id = F.sha2(F.to_json("features"), 256)
    members = materialize(
        policies.select("id", "category").join(sets, "id").select(
            F.col("id").alias("policy_id"), "category", set_id.alias("set_id"), "features"
        ),
        "policy-sets",
    )
    kinds = materialize(members.select("category", "set_id", "features").distinct(), "distinct-sets")
    rarity = kinds.select("category", F.explode("features").alias("f")).groupBy("category", "f").agg(F.count(F.lit(1)).alias("n"))
    ordered = (
        skew_join(kinds.select("category", "set_id", "features", F.explode("features").alias("f")), rarity, ["category", "f"])
        .groupBy("category", "set_id", "features")
        .agg(F.array_sort(F.collect_list(F.struct("n", "f"))).alias("by_rarity"))
    )
    size = F.size("features")
    prefix = F.slice("by_rarity", F.lit(1), (size - F.ceil(F.lit(least) * size) + 1).cast("int"))
    entries = materialize(
        ordered.select("category", "set_id", "features", F.explode(F.transform(prefix, lambda p: p["f"])).alias("f")), "set-prefixes"
    )
    right = entries.select("category", "f", F.col("set_id").alias("other_id"), F.col("features").alias("other"))
    met = skew_join(entries, right, ["category", "f"], spread_by=["set_id"]).where(
        (F.col("set_id") < F.col("other_id"))
        & (F.size("features") >= F.lit(least) * F.size("other"))
        & (F.size("other") >= F.lit(least) * F.size("features"))
    )
    common = F.size(F.array_intersect("features", "other"))
    similarity = common / (F.size("features") + F.size("other") - common).cast("double")
    pairs = (
        met.select("category", "set_id", "other_id", similarity.alias("similarity"))
        .where(F.col("similarity") >= least)
        .distinct()
    )
    return pairs, members


def _both_ways(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(category, set_id, other_id, similarity): every pair from both of its sets, and every set with itself."""
    back = pairs.select("category", F.col("other_id").alias("set_id"), F.col("set_id").alias("other_id"), "similarity")
    same = members.select("category", "set_id", F.col("set_id").alias("other_id"), F.lit(1.0).alias("similarity")).distinct()
    return pairs.unionByName(back).unionByName(same)


def policy_links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """What is like every policy, from :func:`similar_policies`: a row per policy and feature set that is alike.

    (policy_id, category, set_id, features, other_id, other, similarity, links): ``other`` are the names of the set
    ``other_id``, ``links`` the other policies that have it. A policy's own set is among them with similarity 1, and
    with no links if nobody shares it, so every member has a row. Policies of one set are counted, not paired.
    """
    sizes = members.groupBy("category", F.col("set_id").alias("other_id"), F.col("features").alias("other")).agg(
        F.count(F.lit(1)).alias("policies")
    )
    own = (F.col("set_id") == F.col("other_id")).cast("bigint")
    linked = materialize(
        _both_ways(pairs, members).join(sizes, ["category", "other_id"]).select(
            "category", "set_id", "other_id", "other", "similarity", (F.col("policies") - own).alias("links")
        ),
        "set-links",
    )
    return skew_join(members, linked, ["category", "set_id"], spread_by=["policy_id"]).select(
        "policy_id", "category", "set_id", "features", "other_id", "other", "similarity", "links"
    )


def similar_to(wanted: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(policy_id, similar_id, similarity) for a few ``wanted`` policies (column id), from :func:`similar_policies`."""
    asked = members.join(wanted.select(F.col("id").alias("policy_id")), "policy_id", "left_semi").select(
        "policy_id", "category", "set_id"
    )
    partners = members.select(F.col("policy_id").alias("similar_id"), "category", F.col("set_id").alias("other_id"))
    return (
        asked.join(_both_ways(pairs, members), ["category", "set_id"])
        .join(partners, ["category", "other_id"])
        .where(F.col("policy_id") != F.col("similar_id"))
        .select("policy_id", "similar_id", "similarity")
    )
