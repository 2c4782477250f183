"""Graph, identity resolution, separation of duties and escalation."""

from pyspark.sql import functions as F

from gatewarden import bind
from gatewarden.functions.fixed_values import STRICT_ESCALATION_PATTERNS
from gatewarden.operators import access, escalation, graph, identity, sod
from verification.registry import case, joined, r6


@case("permission_resource_links", 'SELECT permission_id, resource_id FROM "grant"')
def _(b):
    return graph.permission_resources(b.estate)


@case("scoped_resource_links", """
SELECT DISTINCT permission_id, resource_id FROM assignment WHERE resource_id IS NOT NULL""")
def _(b):
    return graph.scoped_resources(b.estate)


@case("manager_edges", "SELECT manager_id, id AS subject_id FROM subject WHERE manager_id IS NOT NULL")
def _(b):
    return graph.manager_edges(b.estate)


@case("membership_edges", """
SELECT DISTINCT a.subject_id, 'S' || substr(a.permission_id, 2) AS group_id FROM assignment a
JOIN permission p ON p.id = a.permission_id AND p.type = 'group'
JOIN subject g ON g.id = 'S' || substr(a.permission_id, 2)""")
def _(b):
    # Permissions renamed to subject ids, so that group permissions are subjects too.
    rename = lambda c: F.concat(F.lit("S"), F.substr(F.col(c), F.lit(2)))
    estate = b.estate.with_tables(
        permission=b.estate.permission.withColumn("id", rename("id")),
        assignment=b.estate.assignment.withColumn("permission_id", rename("permission_id")),
    )
    return graph.membership_edges(estate)


@case("graph_edges", "SELECT src, dst, edge_type FROM edge")
def _(b):
    return graph.edges(b.estate)


@case("graph_nodes", "SELECT node, node_type FROM node")
def _(b):
    return graph.nodes(b.estate)


@case("graph_statistics", """
SELECT 'nodes:' || node_type AS metric, count(*) AS value FROM node GROUP BY 1
UNION ALL SELECT 'edges:' || edge_type, count(*) FROM edge GROUP BY 1
UNION ALL SELECT 'total_nodes', count(*) FROM node UNION ALL SELECT 'total_edges', count(*) FROM edge
UNION ALL SELECT 'subjects', count(*) FROM subject UNION ALL SELECT 'permissions', count(*) FROM permission
UNION ALL SELECT 'resources', count(*) FROM resource UNION ALL SELECT 'assignments', count(*) FROM assignment
UNION ALL SELECT 'escalation_paths', count(*) FROM path
UNION ALL SELECT 'sources', count(DISTINCT source) FROM (SELECT source FROM subject UNION ALL SELECT source FROM permission)""")
def _(b):
    return graph.graph_statistics(b.estate)


@case("degree_centrality", """
SELECT s.id AS subject_id, round(coalesce(d.degree, 0) / CAST((SELECT count(*) FROM node) - 1 AS DOUBLE), 9) AS degree_centrality
FROM subject s LEFT JOIN (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) d
ON d.node = 'subject:' || s.id""")
def _(b):
    return graph.degree_centrality(b.estate).select(
        "subject_id", F.round("degree_centrality", 9).alias("degree_centrality")
    )


BETWEENNESS = """
SELECT s.id AS subject_id, round(coalesce(x.total, 0) / ((SELECT count(*) FROM node) - 1) / ((SELECT count(*) FROM node) - 2), 9) + 0.0
  AS betweenness_centrality
FROM subject s LEFT JOIN (
  SELECT v.start AS node, sum(u.n * v.n / w.n) AS total
  FROM counted v JOIN entering m ON m.dst = v.start JOIN counted u ON u.node = v.start AND u.start <> v.start
  JOIN counted w ON w.start = u.start AND w.node = v.node AND w.hops = u.hops + v.hops
  WHERE v.node <> v.start AND v.node <> u.start GROUP BY 1) x ON x.node = 'subject:' || s.id"""


@case("betweenness_centrality", BETWEENNESS, {
    "hop": "SELECT src, dst FROM edge WHERE src <> dst",
    "entering": "SELECT DISTINCT dst FROM hop WHERE starts_with(dst, 'subject:')",
    "start": "SELECT dst AS start FROM entering UNION SELECT h.src FROM hop h JOIN entering m ON m.dst = h.dst",
    # Walks of up to 12 hops; the shortest ones are kept, and counted level by level.
    "walked": "SELECT start, start AS node, 0 AS hops FROM start"
              " UNION SELECT w.start, h.dst, w.hops + 1 FROM walked w JOIN hop h ON h.src = w.node WHERE w.hops < 12",
    "shortest": "SELECT start, node, min(hops) AS hops FROM walked GROUP BY 1, 2",
    "counted": "SELECT start, start AS node, 0 AS hops, CAST(1 AS DOUBLE) AS n FROM start UNION ALL"
               " SELECT c.start, h.dst, c.hops + 1, sum(c.n) FROM counted c JOIN hop h ON h.src = c.node"
               " JOIN shortest s ON s.start = c.start AND s.node = h.dst AND s.hops = c.hops + 1 GROUP BY 1, 2, 3",
})
def _(b):
    found = graph.betweenness_centrality(b.estate)
    return found.select("subject_id", (F.round("betweenness_centrality", 9) + 0.0).alias("betweenness_centrality"))


@case("vertex_dictionary", """
SELECT node, node_type, row_number() OVER (ORDER BY node) - 1 AS vertex FROM node""")
def _(b):
    return graph.numbered(b.estate).vertices


@case("distance_to_critical", """
SELECT s.id AS subject_id, coalesce(min(d.distance), -1) AS distance_to_nearest_critical_resource FROM subject s
LEFT JOIN distance d ON d.node = 'subject:' || s.id GROUP BY 1""")
def _(b):
    return graph.distance_to_critical(b.estate)


@case("manager_depth", """
SELECT s.id AS subject_id, coalesce(max(hops), 0) AS manager_depth FROM subject s LEFT JOIN walk w ON w.subject_id = s.id GROUP BY 1""")
def _(b):
    return graph.manager_depth(b.estate.subject)


@case("blast_radius", """
SELECT s.id AS subject_id, coalesce(d.n, 0) AS direct_resources, coalesce(c.n, 0)::BIGINT AS critical_resources,
 coalesce(p.n, 0) AS escalation_resources, coalesce(d.n, 0) + coalesce(p.n, 0) AS total_reach
FROM subject s LEFT JOIN (SELECT subject_id, count(*) AS n FROM reach GROUP BY 1) d ON d.subject_id = s.id
LEFT JOIN critical_reach c ON c.subject_id = s.id
LEFT JOIN (SELECT subject_id, count(*) AS n FROM path GROUP BY 1) p ON p.subject_id = s.id""")
def _(b):
    return graph.blast_radius(b.estate)


@case("reachable_resources", """
SELECT r.subject_id, r.resource_id, x.name, 'supplier' AS type, x.sensitivity, x.source FROM reach r JOIN resource x ON x.id = r.resource_id""")
def _(b):
    return graph.reachable_resources(b.estate)


@case("critical_resources", """
SELECT a.subject_id, a.permission_id, x.id AS resource_id, x.name, 'supplier' AS type, x.source
FROM (SELECT DISTINCT subject_id, permission_id FROM assignment) a JOIN "grant" g ON g.permission_id = a.permission_id
JOIN resource x ON x.id = g.resource_id AND x.sensitivity = 'critical'""")
def _(b):
    return graph.critical_resources(b.estate)


@case("escalation_resources", """
SELECT subject_id, subject_id || '#' || pattern_no AS path_id, confidence, steps FROM path""")
def _(b):
    return graph.escalation_resources(b.estate).drop("end_result")


@case("identity_components", "SELECT subject_id, component_id FROM component")
def _(b):
    return identity.identity_components(b.estate.subject)


@case("correlated_identities", """
SELECT component_id, max(sources) AS sources, count(*) AS subjects, count(DISTINCT email) AS emails,
  count(DISTINCT display_name) AS names FROM member GROUP BY 1""")
def _(b):
    return identity.component_summary(b.members).withColumn("sources", joined("sources"))


@case("correlated_identity_values", """
SELECT DISTINCT component_id, 'email' AS kind, email AS value FROM member WHERE email IS NOT NULL
UNION SELECT component_id, 'name', display_name FROM member""")
def _(b):
    return identity.component_values(b.members)


@case("cross_system_subjects", "SELECT subject_id, component_id, sources, source_count FROM member")
def _(b):
    return identity.cross_system_subjects(b.members).withColumn("sources", joined("sources"))


@case("singletons", """
SELECT id AS subject_id, source FROM subject WHERE id NOT IN (SELECT subject_id FROM member)""")
def _(b):
    return identity.singletons(b.estate.subject, b.members)


@case("identity_units", "SELECT subject_id, unit_id FROM unit")
def _(b):
    return identity.identity_units(b.estate.subject, b.members)


@case("values_by_source", "SELECT component_id, source, status, department, name FROM by_source")
def _(b):
    return identity.values_by_source(b.members)


@case("inconsistency_profile", """
SELECT component_id, statuses, department_sources, departments, names, sources, coalesce(department_in, '') AS department_in,
 coalesce(deleted_in, '') AS deleted_in, coalesce(active_in, '') AS active_in FROM by_component""")
def _(b):
    return identity.inconsistency_profile(b.members).select(
        "component_id", "statuses", "department_sources", "departments", "names", joined("sources"),
        joined("sources_with_department", "department_in"), joined("deleted_in"), joined("active_in"),
    )


@case("consistency_scores", "SELECT component_id, round(score, 6) AS score FROM consistency")
def _(b):
    return identity.consistency_scores(b.members).select(
        "component_id", r6("cross_system_consistency_score", "score")
    )


@case("sod_violations", "SELECT unit_id, pair_no, key_a, key_b FROM violation")
def _(b):
    return sod.sod_violations(b.estate, b.members, b.pairs)


@case("sod_violation_members", """
SELECT v.unit_id, v.pair_no, u.subject_id, s.display_name, u.sources, u.source_count > 1 AS is_cross_boundary
FROM violation v JOIN unit u ON u.unit_id = v.unit_id JOIN subject s ON s.id = u.subject_id""")
def _(b):
    return sod.sod_violation_members(b.estate, b.members, b.pairs).select(
        "unit_id", "pair_no", "subject_id", "display_name", joined("sources"), "is_cross_boundary"
    )


@case("sod_pair_counts", "SELECT subject_id, n FROM sod_count")
def _(b):
    return sod.sod_counts(b.estate, b.members, b.pairs).withColumnRenamed("sod_pair_membership_count", "n")


@case("escalation_paths_wildcard", """
SELECT subject_id || '#' || pattern_no AS id, subject_id, steps, confidence FROM path""")
def _(b):
    return escalation.detect_escalation_paths(b.estate).select(
        "id", "subject_id", F.size("steps").alias("steps"), "confidence"
    )


@case("escalation_paths_strict", """
SELECT sa.subject_id || '#' || p.no AS id, CAST(max(p.confidence) AS DOUBLE) AS confidence,
  string_agg(p.action, ',' ORDER BY p.action) AS steps FROM (VALUES
 (0, 'iam:CreateRole', 3, 0.99), (0, 'iam:AttachRolePolicy', 3, 0.99), (0, 'sts:AssumeRole', 3, 0.99),
 (1, 'iam:CreateRole', 3, 0.99), (1, 'iam:PutRolePolicy', 3, 0.99), (1, 'sts:AssumeRole', 3, 0.99),
 (2, 'iam:CreateUser', 2, 0.90), (2, 'iam:AttachUserPolicy', 2, 0.90),
 (3, 'iam:PassRole', 2, 0.95), (3, 'lambda:CreateFunction', 2, 0.95),
 (4, 'iam:PassRole', 2, 0.90), (4, 'ec2:RunInstances', 2, 0.90),
 (5, 'iam:CreateAccessKey', 1, 0.80),
 (6, 'iam:UpdateAssumeRolePolicy', 2, 0.95), (6, 'sts:AssumeRole', 2, 0.95)) p(no, action, size, confidence)
JOIN sa ON sa.action = p.action GROUP BY sa.subject_id, p.no HAVING count(*) = max(p.size)""")
def _(b):
    return escalation.detect_escalation_paths(
        b.estate, STRICT_ESCALATION_PATTERNS, wildcards=False, wording="Subject can perform "
    ).select("id", "confidence", F.array_join(F.col("steps.action"), ",").alias("steps"))


@case("escalation_participation", """
SELECT pa.permission_id, count(DISTINCT path.subject_id || '#' || path.pattern_no) AS escalation_chain_participation_count
FROM path JOIN pattern ON pattern.pattern_no = path.pattern_no JOIN permission_action pa ON pa.action = pattern.action GROUP BY 1""")
def _(b):
    return escalation.escalation_participation(b.estate)


@case("has_escalation", """
SELECT s.id AS subject_id, count(p.subject_id) AS escalation_paths_through_identity, count(p.subject_id) > 0 AS has_escalation
FROM subject s LEFT JOIN path p ON p.subject_id = s.id GROUP BY 1""")
def _(b):
    return escalation.has_escalation(b.estate)


@case("admin_group_members", """
SELECT DISTINCT sp.subject_id FROM sp JOIN permission p ON p.id = sp.permission_id
WHERE p.type = 'group' AND regexp_matches(lower(p.name), 'admin|super|owner|root|devops|sre|platform')""")
def _(b):
    from gatewarden.operators.labels import admin_group_members

    return admin_group_members(b.estate)


@case("privileged_categories", """
SELECT sp.subject_id, count(*) AS privileged_role_count,
 concat_ws(',', CASE WHEN bool_or(regexp_matches(t, 'finance|accounting|payroll|treasury|billing|ap|ar|gl')) THEN 'financial' END,
  CASE WHEN bool_or(regexp_matches(t, 'user|directory|group')) THEN 'identity' END,
  CASE WHEN bool_or(regexp_matches(t, 'infra|ec2|compute|network')) THEN 'infrastructure' END,
  CASE WHEN bool_or(regexp_matches(t, 'security|iam|guardduty|waf')) THEN 'security' END) AS categories
FROM sp JOIN (SELECT id, lower(name || ' ' || a0 || ' ' || a1 || ' ' || a2) AS t FROM permission WHERE is_privileged) p
ON p.id = sp.permission_id GROUP BY 1""")
def _(b):
    from gatewarden.operators.labels import privileged_categories

    return privileged_categories(b.estate).select("subject_id", "privileged_role_count", joined("categories"))
