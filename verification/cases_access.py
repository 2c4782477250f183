"""Lookups, held permissions, aggregates, peers, features read off the tables."""

from pyspark.sql import functions as F

from gatewarden import bind
from gatewarden.functions.scalars import as_of_lit, clean_email, clean_name, entity_id, erp_key, whole_days
from gatewarden.operators import access, behaviour, drift, escalation, features, graph, identity, peers, sod
from verification.binding_sql import AS_OF, DRIFT_AS_OF, EVENT_AS_OF, days
from gatewarden.plans.durable import materialize
from verification.registry import case, joined, r6


@case("subjects_bound", """
SELECT id, source, type, display_name, email, department, manager_id, status, mfa_enabled, ingest_seq FROM subject""")
def _(b):
    return b.estate.subject.select(
        "id", "source", "type", "display_name", "email", "department", "manager_id", "status",
        "mfa_enabled", "ingest_seq",
    )


@case("subject_field_rules", """
SELECT id, CASE WHEN type IN ('ai_agent', 'group') THEN NULL ELSE mfa_enabled END AS mfa_enabled,
  CASE WHEN type = 'group' THEN NULL ELSE segment END AS department FROM subject""")
def _(b):
    from gatewarden.sources.canonical import apply_subject_rules

    raw = b.estate.subject.withColumn("department", F.get_json_object("attributes", "$.segment"))
    return apply_subject_rules(raw).select("id", "mfa_enabled", "department")


@case("entity_ids", """
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
 substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS BIGINT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS entity_id
FROM (SELECT id, sha1(unhex('a1b2c3d4e5f67890abcdef1234567890') || encode(source || ':' || external_id)) AS h FROM subject)""")
def _(b):
    return b.estate.subject.select("id", entity_id(F.col("source"), F.col("external_id")).alias("entity_id"))


@case("normalised_keys", """
SELECT id, trim(lower(email)) AS email_key, replace(trim(lower(display_name)), '  ', ' ') AS name_key FROM subject""")
def _(b):
    return b.estate.subject.select(
        "id", clean_email(F.col("email")).alias("email_key"), clean_name(F.col("display_name")).alias("name_key")
    )


@case("erp_keys", """
SELECT DISTINCT action, split_part(split_part(action, ':', 2), '.', 1) AS erp_key FROM permission_action
WHERE action LIKE 'netsuite:%'""")
def _(b):
    actions = b.estate.permission.select(F.explode("actions").alias("action"))
    return actions.where(F.startswith("action", F.lit("netsuite:"))).distinct().select(
        "action", erp_key(F.col("action")).alias("erp_key")
    )


@case("active_assignments_per_subject", """
SELECT subject_id, count(*) AS n FROM assignment WHERE is_active GROUP BY 1""")
def _(b):
    return access.active_assignments(b.estate.assignment).groupBy("subject_id").agg(F.count("*").alias("n"))


@case("subject_lookup", "SELECT id, source, type, status FROM subject WHERE id = 'S7'")
def _(b):
    return access.lookup(b.estate.subject, "S7").select("id", "source", "type", "status")


@case("permission_lookup", "SELECT id, name, type, is_privileged FROM permission WHERE id = 'P51'")
def _(b):
    return access.lookup(b.estate.permission, "P51").select("id", "name", "type", "is_privileged")


@case("resource_lookup", "SELECT id, name, sensitivity FROM resource WHERE id = 'R3'")
def _(b):
    return access.lookup(b.estate.resource, "R3").select("id", "name", "sensitivity")


@case("escalation_paths_of_humans", """
SELECT p.subject_id || '#' || p.pattern_no AS id, p.subject_id FROM path p JOIN subject s ON s.id = p.subject_id WHERE s.type = 'human'""")
def _(b):
    return access.escalation_paths_of(b.estate, b.estate.subject.where(F.col("type") == "human")).select(
        "id", "subject_id"
    )


@case("subject_permissions", """
SELECT sp.subject_id, sp.permission_id, p.is_privileged FROM sp JOIN permission p ON p.id = sp.permission_id""")
def _(b):
    return access.held(b.estate, "is_privileged")


@case("permission_holders", """
SELECT permission_id, count(DISTINCT subject_id) AS holders FROM assignment a JOIN subject s ON s.id = a.subject_id
WHERE a.is_active GROUP BY 1""")
def _(b):
    return access.holders(b.estate).groupBy("permission_id").agg(F.count("*").alias("holders"))


@case("subject_action_sets", "SELECT subject_id, action FROM sa")
def _(b):
    return access.subject_actions(b.estate)


@case("latest_snapshot_wins", f"""
SELECT id, status, CASE WHEN ingest_seq % 3 = 0 THEN 'second' ELSE 'first' END AS snapshot FROM subject""")
def _(b):
    first = b.estate.subject.select("id", "status", "ingest_seq", F.lit("first").alias("snapshot"))
    second = first.where(F.col("ingest_seq") % 3 == 0).withColumn("snapshot", F.lit("second"))
    return access.merge_snapshots([first, second]).select("id", "status", "snapshot")


@case("latest_assignment_per_subject", """
SELECT subject_id, arg_max(id, (granted_at, id)) AS id FROM assignment GROUP BY 1""")
def _(b):
    return access.latest(b.estate.assignment.select("subject_id", "granted_at", "id"), "subject_id",
                         ["granted_at", "id"]).select("subject_id", "id")


@case("source_counts", """
SELECT source, 'subject' AS entity, count(*) AS n FROM subject GROUP BY 1
UNION ALL SELECT source, 'permission', count(*) FROM permission GROUP BY 1
UNION ALL SELECT source, 'resource', count(*) FROM resource GROUP BY 1
UNION ALL SELECT source, 'assignment', count(*) FROM assignment GROUP BY 1
UNION ALL SELECT source, 'escalation_path', count(*) FROM path GROUP BY 1""")
def _(b):
    return access.source_counts(b.estate)


@case("estate_totals", """
SELECT (SELECT count(*) FROM subject) AS subjects, (SELECT count(*) FROM permission) AS permissions,
 (SELECT count(*) FROM resource) AS resources, (SELECT count(*) FROM assignment) AS assignments,
 (SELECT count(*) FROM path) AS escalation_paths""")
def _(b):
    return access.estate_totals(b.estate)


@case("unique_actions", "SELECT subject_id, count(DISTINCT action) AS unique_actions FROM sa GROUP BY 1")
def _(b):
    return access.action_counts(b.estate)


@case("permission_counts", """
SELECT sp.subject_id, count(*) AS total_permissions, count(CASE WHEN p.is_privileged THEN 1 END) AS privileged_permissions,
  round(sum(9.0) / pow(sum(3.0), 2), 6) AS permission_concentration
FROM sp JOIN permission p ON p.id = sp.permission_id GROUP BY 1""")
def _(b):
    return access.permission_counts(b.estate).withColumn("permission_concentration", r6("permission_concentration"))


@case("subject_profile", f"""
SELECT id AS subject_id, source, type, status, coalesce(department, 'unknown') AS department,
  coalesce({days(AS_OF, 'created_at')}, 0) AS account_age_days,
  coalesce({days(AS_OF, 'last_seen')}, -1) AS days_since_last_activity,
  CASE WHEN mfa_enabled IS NULL THEN 0.5 WHEN mfa_enabled THEN 1.0 ELSE 0.0 END::DOUBLE AS mfa_usage_rate FROM subject""")
def _(b):
    return features.profile(b.estate, bind.AS_OF).drop("trust_policy_open")


@case("peer_groups", "SELECT peer_department, peer_type, count(*) AS n FROM peer GROUP BY 1, 2")
def _(b):
    return peers.peer_members(b.estate.subject).groupBy(*peers.PEER_KEY).agg(F.count("*").alias("n"))


@case("peer_statistics", """
SELECT peer_department, peer_type, group_size, upper_median, round(peer_mean, 6) AS peer_mean,
  round(peer_std, 6) AS peer_std FROM peer_stats""")
def _(b):
    return peers.peer_statistics(peers.peer_permission_counts(b.estate)).select(
        *peers.PEER_KEY, "group_size", "upper_median", r6("peer_mean"), r6("peer_std")
    )


@case("peer_scores", """
SELECT p.subject_id, round(r.ratio, 6) AS ratio,
  round(CASE WHEN st.group_size < 3 OR st.peer_std = 0 THEN 0.0 ELSE (p.n - st.peer_mean) / st.peer_std END, 6) + 0.0 AS deviation
FROM peer p JOIN peer_ratio r ON r.subject_id = p.subject_id
JOIN peer_stats st ON st.peer_department = p.peer_department AND st.peer_type = p.peer_type""")
def _(b):
    return peers.peer_scores(b.estate).select(
        "subject_id", r6("permission_to_peer_median_ratio", "ratio"), r6("peer_group_deviation_score", "deviation")
    )


@case("peer_similarity", """
SELECT p.subject_id, round(CASE WHEN o.own IS NULL THEN 0.0 WHEN g.size = 1 THEN 1.0
  WHEN g.squares - o.share <= 0 THEN 0.0 ELSE o.dot / (sqrt(o.own) * sqrt(g.squares - o.share)) END, 6) AS similarity
FROM peer p
JOIN (SELECT x.peer_department, x.peer_type, x.size, y.squares FROM
   (SELECT peer_department, peer_type, count(*) AS size FROM peer GROUP BY 1, 2) x
   LEFT JOIN (SELECT peer_department, peer_type, sum(c * c)::DOUBLE AS squares FROM holders_of GROUP BY 1, 2) y
   ON x.peer_department = y.peer_department AND x.peer_type = y.peer_type) g
  ON g.peer_department = p.peer_department AND g.peer_type = p.peer_type
LEFT JOIN (SELECT q.subject_id, count(*)::DOUBLE AS own, sum(h.c - 1)::DOUBLE AS dot, sum(2 * h.c - 1)::DOUBLE AS share
  FROM peer q JOIN sa ON sa.subject_id = q.subject_id
  JOIN holders_of h ON h.peer_department = q.peer_department AND h.peer_type = q.peer_type AND h.action = sa.action
  GROUP BY 1) o ON o.subject_id = p.subject_id""",
      extra={"holders_of": """
SELECT q.peer_department, q.peer_type, sa.action, count(*) AS c FROM peer q JOIN sa ON sa.subject_id = q.subject_id GROUP BY 1, 2, 3"""})
def _(b):
    return peers.peer_similarity(b.estate).select("subject_id", r6("peer_group_cosine_similarity", "similarity"))


@case("department_means", """
SELECT coalesce(department, 'unknown') AS department, round(avg(total_permissions), 6) AS mean_permissions, count(*) AS n
FROM subject s JOIN perm_counts c ON c.subject_id = s.id GROUP BY 1 HAVING count(*) >= 3 AND avg(total_permissions) > 15
 AND coalesce(department, 'unknown') <> 'unknown'""", extra=None)
def _(b):
    from gatewarden.operators.suggestions import department_means

    counts = access.permission_counts(b.estate).select("subject_id", "total_permissions")
    rows = features.profile(b.estate, bind.AS_OF).join(counts, "subject_id", "left").withColumn(
        "total_permissions", F.coalesce("total_permissions", F.lit(0).cast("bigint"))
    )
    return department_means(rows).select("department", r6("mean_permissions"), "n")


@case("assignment_features", f"""
SELECT a.id AS assignment_id, coalesce({days(AS_OF, 'granted_at')}, 0) AS assignment_age_days,
 coalesce({days(AS_OF, 'last_used')}, -1) AS days_since_last_used,
 CASE WHEN granted_by IS NULL THEN 'unknown' WHEN granted_by IN ('aws_iam', 'okta', 'entra', 'netsuite') THEN 'system'
   WHEN lower(granted_by) LIKE '%auto%' THEN 'automation' WHEN granted_by LIKE '%@%' THEN 'human' ELSE 'unknown' END AS granted_by_type,
 coalesce(justification <> '', false) AS has_business_justification,
 EXISTS (SELECT 1 FROM erp_held own JOIN pair ON own.key IN (key_a, key_b) JOIN erp_held other
   ON other.subject_id = a.subject_id AND other.key = CASE WHEN own.key = key_a THEN key_b ELSE key_a END
   WHERE own.subject_id = a.subject_id AND own.permission_id = a.permission_id) AS is_sod_pair_member
FROM assignment a WHERE is_active""", extra={"erp_held": """
SELECT sp.subject_id, sp.permission_id, split_part(split_part(action, ':', 2), '.', 1) AS key FROM sp
JOIN permission_action pa ON pa.permission_id = sp.permission_id WHERE action LIKE 'netsuite:%'"""})
def _(b):
    return features.assignment_features(b.estate, bind.AS_OF, b.pairs).drop("subject_id", "permission_id")


@case("permission_features", """
SELECT p.id AS permission_id, 3 AS total_actions,
  (SELECT count(*) FROM (VALUES (a0), (a1), (a2)) t(x) WHERE x IN ('iam:CreateRole', 'iam:AttachRolePolicy', 'iam:PassRole',
    'iam:CreateAccessKey', 'sts:AssumeRole', 'lambda:CreateFunction', 'ec2:RunInstances') OR x LIKE '%:*') AS high_risk_action_count,
  (a0 LIKE '%*%' OR coalesce(x.star, false)) AS wildcard_presence, coalesce(x.n, 0) AS resource_scope_breadth,
  coalesce(h.n, 0) AS holder_count, round(coalesce(h.humans, 0) / greatest(coalesce(h.n, 0), 1)::DOUBLE, 6) AS human_share,
  round(coalesce(h.services, 0) / greatest(coalesce(h.n, 0), 1)::DOUBLE, 6) AS service_share,
  round(coalesce(h.agents, 0) / greatest(coalesce(h.n, 0), 1)::DOUBLE, 6) AS agent_share,
  round(coalesce(h.use, 0.0), 6) AS average_usage_rate_across_holders,
  p.is_privileged, CASE WHEN p.k % 50 = 1 THEN 1 ELSE 0 END AS risk_keyword_count,
  coalesce(e.n, 0) AS escalation_chain_participation_count
FROM permission p
LEFT JOIN (SELECT permission_id, count(*) AS n, bool_or(resource_string = '*') AS star FROM permission_resource GROUP BY 1) x ON x.permission_id = p.id
LEFT JOIN (SELECT d.permission_id, count(*) AS n, count(CASE WHEN s.type = 'human' THEN 1 END) AS humans,
   count(CASE WHEN s.type = 'service_account' THEN 1 END) AS services, count(CASE WHEN s.type = 'ai_agent' THEN 1 END) AS agents,
   avg(coalesce(u.usage_ratio, 0.0)) AS use
   FROM (SELECT DISTINCT permission_id, subject_id FROM assignment WHERE is_active) d JOIN subject s ON s.id = d.subject_id
   LEFT JOIN usage u ON u.subject_id = s.id GROUP BY 1) h ON h.permission_id = p.id
LEFT JOIN (SELECT pa.permission_id, count(DISTINCT path.subject_id || '#' || path.pattern_no) AS n FROM path
   JOIN pattern ON pattern.pattern_no = path.pattern_no JOIN permission_action pa ON pa.action = pattern.action GROUP BY 1) e
  ON e.permission_id = p.id""")
def _(b):
    shares = ("human_share", "service_share", "agent_share", "average_usage_rate_across_holders")
    out = features.permission_features(b.estate)
    return out.select(*[r6(c) if c in shares else F.col(c) for c in out.columns])


@case("behaviour_activity", """
SELECT subject_id, round(avg_daily_api_calls_30d, 6) AS avg_daily_api_calls_30d, round(login_time_entropy, 6) AS login_time_entropy,
 distinct_source_ips_30d FROM activity""")
def _(b):
    return behaviour.activity(b.estate, bind.EVENT_AS_OF).select(
        "subject_id", r6("avg_daily_api_calls_30d"), r6("login_time_entropy"), "distinct_source_ips_30d"
    )


@case("usage_ratios", "SELECT subject_id, round(usage_ratio, 6) AS usage_ratio FROM usage")
def _(b):
    return behaviour.usage_ratios(b.estate).select("subject_id", r6("usage_ratio"))


@case("days_since_last_activity_with_events", f"""
SELECT s.id AS subject_id, coalesce({days(EVENT_AS_OF, 'greatest(s.last_seen, e.newest)')}, -1) AS days_since_last_activity
FROM subject s LEFT JOIN (SELECT actor_id, max(ts) AS newest FROM event GROUP BY 1) e ON e.actor_id = s.id""")
def _(b):
    return behaviour.days_since_last_activity(b.estate, bind.EVENT_AS_OF, include_events=True)


@case("event_log_statistics", """
SELECT count(*) AS total_events, count(DISTINCT actor_id) AS unique_subjects, count(DISTINCT raw_event_name) AS unique_actions,
 count(DISTINCT source_ip) AS unique_ips, 0 AS privileged_events, count(CASE WHEN NOT success THEN 1 END) AS error_events,
 epoch_us(min(ts)) AS range_start, epoch_us(max(ts)) AS range_end FROM event""")
def _(b):
    return behaviour.event_log_statistics(b.estate.event).select(
        "total_events", "unique_subjects", "unique_actions", "unique_ips", "privileged_events", "error_events",
        F.unix_micros("time_range_start").alias("range_start"), F.unix_micros("time_range_end").alias("range_end"),
    )


@case("event_log_sketches", """
SELECT count(*) AS total_events, true AS subjects_within, true AS actions_within, true AS ips_within, epoch_us(max(ts)) AS range_end FROM event""")
def _(b):
    # Days stored apart and merged; estimates stand within four standard errors of the exact counts.
    days = materialize(behaviour.daily_sketches(b.estate.event), "daily-sketches")
    exact = behaviour.event_log_statistics(b.estate.event).select(*[F.col(f"unique_{c}").alias(f"exact_{c}") for c in ("subjects", "actions", "ips")])
    merged = behaviour.statistics_of_days(days).join(exact)
    within = lambda c: (F.abs(F.col(f"unique_{c}") - F.col(f"exact_{c}")) <= 0.0325 * F.col(f"exact_{c}")).alias(f"{c}_within")
    return merged.select("total_events", within("subjects"), within("actions"), within("ips"), F.unix_micros("time_range_end").alias("range_end"))


@case("event_type_distribution", """
SELECT event_type, count(*) AS n FROM event GROUP BY 1 ORDER BY n DESC, event_type LIMIT 20""")
def _(b):
    return behaviour.event_type_distribution(b.estate.event)


@case("ingestion_summary", """
SELECT source, sum(n)::BIGINT AS total_events, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS events_by_type,
  epoch_us(min(lo)) AS oldest, epoch_us(max(hi)) AS newest
FROM (SELECT source, event_type, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM event GROUP BY 1, 2) GROUP BY 1""")
def _(b):
    return behaviour.ingestion_summary(b.estate.event).select(
        "source", "total_events",
        F.array_join(
            F.transform(
                F.map_entries("events_by_type"),
                lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
            ), ",",
        ).alias("events_by_type"),
        F.unix_micros("oldest_event").alias("oldest"), F.unix_micros("newest_event").alias("newest"),
    )


@case("permission_drift", """
SELECT subject_id, permissions_added_7d, permissions_removed_7d, permissions_added_30d, permissions_removed_30d,
 permissions_added_90d, permissions_removed_90d, round(net_drift_rate, 6) AS net_drift_rate FROM drift""")
def _(b):
    out = drift.permission_drift(b.estate, bind.DRIFT_AS_OF)
    return out.withColumn("net_drift_rate", r6("net_drift_rate"))


@case("permission_changes_90d", """
SELECT subject_id, permission_id, CASE WHEN t0 THEN 'added' ELSE 'removed' END AS change FROM drift_pair WHERE t0 <> t90""")
def _(b):
    before = drift.held_pairs_at(b.estate, "2001-05-04 00:00:00")
    return drift.permission_changes(before, drift.held_pairs_at(b.estate, bind.DRIFT_AS_OF))


@case("days_since_review", f"""
SELECT actor_id AS subject_id, {days(EVENT_AS_OF, 'max(ts)')} AS days_since_last_access_review FROM event
JOIN subject s ON s.id = actor_id WHERE raw_event_name LIKE 'svc0:%' GROUP BY 1""")
def _(b):
    return drift.days_since_review(
        b.estate, bind.EVENT_AS_OF, F.startswith("raw_event_name", F.lit(bind.REVIEW_PREFIX))
    )


@case("whole_days_between", f"""
SELECT id, {days(AS_OF, 'granted_at')} AS since_grant, {days("TIMESTAMP '1999-06-15 12:00:00'", 'granted_at')} AS signed FROM assignment""")
def _(b):
    return b.estate.assignment.select(
        "id",
        whole_days(as_of_lit(bind.AS_OF), F.col("granted_at")).alias("since_grant"),
        whole_days(as_of_lit("1999-06-15 12:00:00"), F.col("granted_at")).alias("signed"),
    )
