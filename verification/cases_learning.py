"""Training tables, metrics, models, injection, streaming."""

from pyspark.sql import functions as F

from gatewarden import bind
from gatewarden.functions.fixed_values import MODEL_IDS
from gatewarden.functions.scalars import as_of_lit
from gatewarden.operators import access, features as feats, graph, injection, labels, learning
from gatewarden.operators.scorers import PythonModel, Registry
from gatewarden.plans.durable import durable_root, materialize
from gatewarden.sources import cloudtrail, identity_logs, tables
from gatewarden.streaming import ingest
from verification import payloads
from verification.binding_sql import EVENT_AS_OF, days
from verification.cases_rules import EXTRA, SQL
from verification.cases_signals import LABELS, CountsOnly
from verification.cases_sources import _scratch, label_json
from verification.registry import case, r6


@case(
    "label_matrix",
    "SELECT s.id AS subject_id, "
    + ", ".join(f"max(CASE WHEN violation_class = {c} THEN 1 ELSE 0 END) AS class_{c}" for c in learning.CLASSES)
    + " FROM subject s LEFT JOIN label_row l ON l.subject_id = s.id GROUP BY 1",
    LABELS,
)
def _(b):
    ids = b.estate.subject.select(F.col("id").alias("subject_id"))
    return learning.label_matrix(ids, b.labels)


@case("class_balance", """
SELECT c AS violation_class, n_pos, total - n_pos AS n_neg, round((total - n_pos) / greatest(n_pos, 1)::DOUBLE, 6) AS scale_pos,
 round(n_pos / total::DOUBLE, 6) AS positive_rate FROM (SELECT c, count(DISTINCT l.subject_id) AS n_pos, (SELECT count(*) FROM subject) AS total
 FROM (SELECT unnest(range(1, 16)) AS c) LEFT JOIN label_row l ON l.violation_class = c GROUP BY 1)""", LABELS)
def _(b):
    ids = b.estate.subject.select(F.col("id").alias("subject_id"))
    return learning.class_balance(learning.label_matrix(ids, b.labels)).select(
        "violation_class", "n_pos", "n_neg", r6("scale_pos"), r6("positive_rate")
    )


def three_sources(b):
    k = F.col("k")
    base = tables.labels_from_json(label_json(b), "bootstrap")
    human = base.where(F.substr("subject_id", F.lit(2)).cast("bigint") % 2 == 0).withColumn("source", F.lit("human"))
    implicit = base.where(F.substr("subject_id", F.lit(2)).cast("bigint") % 3 == 0).withColumn("source", F.lit("implicit"))
    return base.unionByName(human.withColumn("label", 1 - F.col("label"))).unionByName(implicit)


@case("merged_labels", """
SELECT 'S' || k AS subject_id, c AS violation_class, CASE WHEN k % 3 = 0 THEN (k + c) % 2 WHEN k % 2 = 0 THEN 1 - (k + c) % 2 ELSE (k + c) % 2 END AS label,
 CASE WHEN k % 3 = 0 THEN 0.8 WHEN k % 2 = 0 THEN 1.0 ELSE 0.3 END::DOUBLE AS weight FROM (SELECT c_custkey AS k FROM customer), (SELECT unnest([1, 2, 3]) AS c)""")
def _(b):
    return learning.merge_labels(three_sources(b)).select(
        "subject_id", "violation_class", "label", r6("weight")
    )


@case("aligned_rows", """
SELECT 'S' || c_custkey AS subject_id, total_permissions FROM customer JOIN perm_counts ON subject_id = 'S' || c_custkey WHERE total_permissions > 0""")
def _(b):
    counts = access.permission_counts(b.estate).select("subject_id", "total_permissions")
    return learning.aligned(counts, learning.merge_labels(three_sources(b)), 2).select("subject_id", "total_permissions")


@case("stratified_split", """
SELECT is_active AS label, CAST(floor(count(*) * 0.8) AS BIGINT) AS train, count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) AS test FROM assignment GROUP BY 1""")
def _(b):
    rows = b.estate.assignment.select("id", F.col("is_active").alias("label"))
    return learning.stratified_split(rows, "label", "id").groupBy("label").agg(
        F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test")
    )


CONFUSION = """
SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn,
 count(*) FILTER (y = 0 AND p = 0) AS tn FROM (SELECT is_active::INT AS y, (granted_at > TIMESTAMP '2000-01-01 00:00:00')::INT AS p FROM assignment)"""


@case("classifier_metrics", """
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS accuracy, round(tp / (tp + fp)::DOUBLE, 4) AS precision,
 round(tp / (tp + fn)::DOUBLE, 4) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4) AS f1 FROM confusion""", {"confusion": CONFUSION})
def _(b):
    return learning.confusion_metrics(guesses(b))


def guesses(b):
    return b.estate.assignment.select(
        F.col("is_active").cast("int").alias("label"),
        (F.col("granted_at") > as_of_lit("2000-01-01 00:00:00")).cast("int").alias("prediction"), "permission_id",
    )


@case("metric_delta", """
SELECT kind, round(round(avg((y = p)::INT), 4) - 0.5, 4) AS accuracy_delta FROM (SELECT is_active::INT AS y,
  (granted_at > TIMESTAMP '2000-01-01 00:00:00')::INT AS p, type AS kind FROM assignment a JOIN permission q ON q.id = a.permission_id) GROUP BY 1""")
def _(b):
    kinds = b.estate.permission.select(F.col("id").alias("permission_id"), F.col("type").alias("kind"))
    tuned = learning.confusion_metrics(guesses(b).join(kinds, "permission_id"), ["kind"])
    base = tuned.select("kind", *[F.lit(0.5).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
    return learning.metric_delta(base, tuned, "kind").select("kind", "accuracy_delta")


RATES = "0.05 + 0.10 + 0.08 + 0.03 + 0.04 + 0.15 + 0.05 + 0.02 + 0.01"


@case("injection_cohorts", """
SELECT cohort, CAST(floor((SELECT count(*) FROM subject WHERE type <> 'group') * rate) AS BIGINT) AS n FROM (VALUES ('sod', 0.05::DOUBLE), ('excess', 0.10),
 ('dormant', 0.08), ('orphan', 0.03), ('escalation', 0.04), ('mfa', 0.15), ('open_trust', 0.05), ('toxic', 0.02), ('break_glass', 0.01)) t(cohort, rate)
WHERE CAST(floor((SELECT count(*) FROM subject WHERE type <> 'group') * rate) AS BIGINT) > 0""")
def _(b):
    return injection.cohorts(b.estate.subject, 42).groupBy("cohort").agg(F.count("*").alias("n"))


@case("injection_truth")
def _(b):
    return injection.inject_violations(b.estate, bind.AS_OF)[1].drop("source_systems")


@case("rule_recall_on_injected")
def _(b):
    """Injected estate, labelled by the rules that need no event or peer features."""
    injected, truth = injection.inject_violations(b.estate, bind.AS_OF)
    inputs = CountsOnly(b)
    inputs.estate = injected.with_tables(
        subject=materialize(injected.subject, "subject"), permission=materialize(injected.permission, "permission"),
        assignment=materialize(injected.assignment, "assignment"),
    )
    profile = feats.profile(inputs.estate, bind.AS_OF)
    inputs.features = profile.join(access.permission_counts(inputs.estate), "subject_id", "left").fillna(0)
    found = None
    for rule in (
        labels.dormant_labels, labels.open_trust_labels, labels.missing_mfa_labels,
        labels.toxic_security_finance_labels, labels.break_glass_labels, labels.escalation_labels,
    ):
        rows = rule(inputs).select("subject_id", "violation_class", "label")
        found = rows if found is None else found.unionByName(rows)
    return learning.rule_recall(found, truth)


RECALL = """
SELECT violation_class, tp, fp, fn, coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 4), 0) AS recall,
 coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 4), 0) AS precision FROM (
 SELECT violation_class, count(*) FILTER (t AND f) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (t AND NOT f) AS fn FROM (
  SELECT subject_id, violation_class, bool_or(k = 't') AS t, bool_or(k = 'f') AS f FROM (
   SELECT subject_id, violation_class, 'f' AS k FROM label_row
   UNION ALL SELECT 'S' || c_custkey, c, 't' FROM customer, (SELECT unnest([1, 2, 3]) AS c) WHERE c_custkey % 2 = 0 AND (c_custkey + c) % 2 = 0)
  GROUP BY 1, 2) GROUP BY 1)"""


@case("rule_recall_on_labels", RECALL, LABELS)
def _(b):
    """All rules against the labels that people gave."""
    human = three_sources(b).where(F.col("source") == "human")
    return learning.rule_recall(b.labels, human)


@case("flat_vectors")
def _(b):
    from pyspark.ml.functions import vector_to_array

    vectors = feats.flat_vectors(b.features)
    return vectors.select("subject_id", F.array_join(F.transform(vector_to_array("features"), lambda v: F.round(v, 6).cast("string")), " ").alias("vector"))


# Vector columns that SQL can state, by name; the others are the hashed department and columns checked on their own.
VECTOR_VALUES = (
    "account_age_days", "days_since_last_activity", "total_permissions", "privileged_permissions", "source_system_count",
    "unique_resources_reachable", "permission_to_peer_median_ratio", "usage_ratio", "login_time_entropy", "distinct_source_ips_30d",
    "mfa_usage_rate", "degree_centrality", "distance_to_nearest_critical_resource", "escalation_paths_through_identity",
    "permissions_added_30d", "permissions_removed_30d", "permissions_added_90d", "permissions_removed_90d", "net_drift_rate",
    "days_since_last_access_review", "cross_system_consistency_score", "sod_pair_membership_count",
)


@case("vector_values", f"""
SELECT f.subject_id, f.account_age_days, f.days_since_last_activity, f.total_permissions, f.privileged_permissions, f.source_system_count,
 coalesce(r.n, 0) AS unique_resources_reachable, CASE WHEN f.type = 'group' THEN NULL ELSE round(f.permission_to_peer_median_ratio, 6) END AS permission_to_peer_median_ratio,
 round(f.usage_ratio, 6) AS usage_ratio, round(f.login_time_entropy, 6) AS login_time_entropy, f.distinct_source_ips_30d, f.mfa_usage_rate,
 round(coalesce(g.degree, 0) / ((SELECT count(*) FROM node) - 1)::DOUBLE, 6) AS degree_centrality,
 coalesce(x.distance, -1) AS distance_to_nearest_critical_resource, coalesce(e.n, 0) AS escalation_paths_through_identity,
 f.permissions_added_30d, f.permissions_removed_30d, f.permissions_added_90d, f.permissions_removed_90d, round(f.net_drift_rate, 6) AS net_drift_rate,
 coalesce(v.age, -1) AS days_since_last_access_review, round(f.cross_system_consistency_score, 6) AS cross_system_consistency_score, f.sod_pair_membership_count
FROM feature f LEFT JOIN (SELECT subject_id, count(*) AS n FROM reach GROUP BY 1) r ON r.subject_id = f.subject_id
LEFT JOIN (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) g ON g.node = 'subject:' || f.subject_id
LEFT JOIN (SELECT node, min(distance) AS distance FROM distance GROUP BY 1) x ON x.node = 'subject:' || f.subject_id
LEFT JOIN (SELECT subject_id, count(*) AS n FROM path GROUP BY 1) e ON e.subject_id = f.subject_id
LEFT JOIN (SELECT actor_id, {days(EVENT_AS_OF, 'max(ts)')} AS age FROM event WHERE raw_event_name LIKE 'svc0:%' GROUP BY 1) v ON v.actor_id = f.subject_id""")
def _(b):
    from pyspark.ml.functions import vector_to_array

    vectors = feats.flat_vectors(b.features).withColumn("v", vector_to_array("features"))
    value = lambda n: F.get("v", F.lit(feats.SUBJECT_VECTOR.index(n)))
    is_group = value("type_code") == feats.TYPE_CODES["group"]
    columns = [r6(value(n), n) for n in VECTOR_VALUES if n != "permission_to_peer_median_ratio"]
    # Groups have no peers; their ratio is checked with the peer queries.
    ratio = F.when(~is_group, F.round(value("permission_to_peer_median_ratio"), 6) + 0.0).alias("permission_to_peer_median_ratio")
    return vectors.select("subject_id", *columns, ratio)


@case("subject_features", """
SELECT subject_id, account_age_days, days_since_last_activity, total_permissions, privileged_permissions, round(permission_to_peer_median_ratio, 6) AS ratio,
 source_system_count, round(usage_ratio, 6) AS usage_ratio, distinct_source_ips_30d, round(login_time_entropy, 6) AS login_time_entropy,
 permissions_added_90d, permissions_removed_90d, round(net_drift_rate, 6) AS net_drift_rate, sod_pair_membership_count,
 round(cross_system_consistency_score, 6) AS consistency FROM feature""")
def _(b):
    return b.features.select(
        "subject_id", "account_age_days", "days_since_last_activity", "total_permissions", "privileged_permissions",
        r6("permission_to_peer_median_ratio", "ratio"), "source_system_count", r6("usage_ratio"),
        "distinct_source_ips_30d", r6("login_time_entropy"), "permissions_added_90d", "permissions_removed_90d",
        r6("net_drift_rate"), "sod_pair_membership_count", r6("cross_system_consistency_score", "consistency"),
    )


def training(b):
    """The flat vectors of all subjects with the labels of all rules."""
    vectors = feats.flat_vectors(b.features)
    return vectors, b.shared("training", lambda: learning.training_set([(vectors, b.labels)]))


def models(b):
    """All classes at the declared 200 rounds, trained once per session and folder."""
    return b.shared("trained-models", lambda: learning.train_all(training(b)[1])[0])


@case("trained_model_metrics")
def _(b):
    return learning.train_all(training(b)[1])[1]


@case("training_counts", """
SELECT c AS violation_class, floor(0.8 * p) + floor(0.8 * (n - p)) AS n_train, floor(0.8 * p) AS n_positive,
  n - floor(0.8 * p) - floor(0.8 * (n - p)) AS n_held_out, 200 AS rounds
FROM (SELECT c, count(DISTINCT l.subject_id) AS p, (SELECT count(*) FROM subject) AS n
 FROM (SELECT unnest(range(1, 16)) AS c) LEFT JOIN label_row l ON l.violation_class = c GROUP BY 1) WHERE floor(0.8 * p) > 0""", LABELS)
def _(b):
    metrics = learning.train_all(training(b)[1])[1]
    held_out = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return metrics.select("violation_class", "n_train", "n_positive", held_out.alias("n_held_out"), "rounds")


def registry(b):
    trained = models(b)
    known = Registry()
    for c in [r.violation_class for r in trained.select("violation_class").collect()]:
        known.register_scorer(MODEL_IDS[c], learning.model_scorer(trained, c))
    return known


@case("scored_signals")
def _(b):
    vectors, _ = training(b)
    ranked, _ = learning.score_all(registry(b), vectors, graph.blast_radius(b.estate), as_of_lit(bind.AS_OF))
    return ranked.select("signal_id", "model_id", "entity_id", "confidence", "severity")


class HoardingModel:
    """A user's model: privileged share of what a subject holds; it cannot judge holders of nothing."""

    def predict(self, row):
        share = row["privileged_permissions"] / row["total_permissions"]
        return [(share, "review_access")] if share >= 0.5 else []


USER_MODEL = """
SELECT subject_id, total_permissions AS t, privileged_permissions AS p FROM perm_counts"""


def user_model_run(b):
    held = access.permission_counts(b.estate).select("subject_id", "total_permissions", "privileged_permissions")
    counts = b.estate.subject.select(F.col("id").alias("subject_id")).join(held, "subject_id", "left").fillna(0)
    known = Registry()
    known.register_tier2("PB", PythonModel("any", HoardingModel))
    return known.run(counts)


@case("user_model_detections", """
SELECT 'T2-PB' AS model_id, subject_id, round(p / t::DOUBLE, 6) AS confidence, 'review_access' AS action FROM held WHERE t > 0 AND p / t::DOUBLE >= 0.5""",
      {"held": USER_MODEL})
def _(b):
    return user_model_run(b)[0].select("model_id", "subject_id", r6("confidence"), "action")


@case("user_model_failures", """
SELECT 'T2-PB' AS model_id, 'ZeroDivisionError' AS kind, count(*) AS failures FROM held WHERE t = 0 HAVING count(*) > 0""",
      {"held": USER_MODEL})
def _(b):
    failed = user_model_run(b)[1].groupBy("model_id", F.substring_index("error", ":", 1).alias("kind"))
    return failed.agg(F.count(F.lit(1)).alias("failures"))


@case("fine_tuned_metrics")
def _(b):
    vectors, _ = training(b)
    return learning.fine_tune(models(b), vectors, learning.merge_labels(three_sources(b)))[1]


# --- streaming -------------------------------------------------------------------------------


def landed(b, rows, name):
    """Write JSON text rows as a landing folder of log files."""
    path = _scratch(b, name)
    rows.write.text(path)
    return path


def streamed(b, build, feed="okta", rows=payloads.okta_events, mode="append"):
    path = landed(b, rows(b), f"landing-{feed}")
    stream = build(ingest.stream_feed(b.spark, feed, path))
    out = _scratch(b, "stream-out")
    ingest.run_available(stream, out, _scratch(b, "stream-checkpoint"), mode)
    return b.spark.read.schema(stream.schema).parquet(out)


@case("stream_okta_events", """
SELECT 'o-' || event_id AS source_event_id, epoch_us(date_trunc('second', ts)) AS at FROM events WHERE event_id % 11 NOT IN (7, 8) AND event_id % 50 <> 7""")
def _(b):
    return streamed(b, lambda s: s).select("source_event_id", F.unix_micros("timestamp").alias("at"))


@case("stream_cloudtrail_events", """
SELECT 'ev-' || event_id AS source_event_id FROM events WHERE event_id % 50 <> 7 AND (event_id % 4 <> 0 OR event_id % 7 < 2)""")
def _(b):
    return streamed(b, lambda s: s, "cloudtrail", payloads.trail_records).select("source_event_id")


@case("stream_without_repeats", """
SELECT 'o-' || event_id AS source_event_id FROM events WHERE event_id % 11 NOT IN (7, 8) AND event_id % 50 <> 7""")
def _(b):
    twice = lambda x: payloads.okta_events(x).unionByName(payloads.okta_events(x))
    return streamed(b, ingest.without_repeats, rows=twice).select("source_event_id")


LANDED = "event_id % 11 NOT IN (7, 8) AND event_id % 50 <> 7"


def landed_events(b, rows=payloads.okta_events):
    """The streamed events once more, as a batch."""
    return ingest.landed_feed(b.spark, "okta", landed(b, rows(b), "landing-okta-batch"))


@case("stream_daily_summary", f"""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS total_events, count(*) FILTER (event_type = 'error') AS errors FROM events
WHERE {LANDED} GROUP BY 1""")
def _(b):
    rows = ingest.with_open_days(streamed(b, ingest.daily_summary), landed_events(b), ingest.daily_summary)
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "total_events", "errors")


ACTOR = "CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id || '@corp.test' ELSE 'id' || user_id END"
LAST_30 = f"""{LANDED} AND date_trunc('day', ts) >= TIMESTAMP '{bind.EVENT_AS_OF}' - INTERVAL 30 DAY
 AND date_trunc('day', ts) < TIMESTAMP '{bind.EVENT_AS_OF}'"""


@case("stream_daily_activity_rollup", f"""
SELECT {ACTOR} AS actor_id, round(count(*) / 30.0, 6) AS avg_daily_api_calls_30d FROM events WHERE {LAST_30} GROUP BY 1""")
def _(b):
    days = ingest.with_open_days(streamed(b, ingest.daily_activity), landed_events(b), ingest.daily_activity)
    return ingest.thirty_day_rollup(days, bind.EVENT_AS_OF).select("actor_id", r6("avg_daily_api_calls_30d"))


@case("stream_daily_addresses_rollup", f"""
SELECT actor_id, count(DISTINCT ip) AS distinct_source_ips_30d FROM (SELECT {ACTOR} AS actor_id,
 '10.0.0.' || json_extract_string(props, '$.k') AS ip FROM events WHERE {LAST_30}) WHERE ip <> '' GROUP BY 1""")
def _(b):
    days = ingest.with_open_days(streamed(b, ingest.daily_addresses), landed_events(b), ingest.daily_addresses)
    return ingest.thirty_day_addresses(days, bind.EVENT_AS_OF)
