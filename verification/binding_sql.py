"""The test-table binding (see ``gatewarden.bind``) and shared steps, as SQL CTEs.

``with_ctes(body)`` prefixes a query with the CTEs it mentions, and only those.
"""

from __future__ import annotations

import re

SOURCES = "['aws_iam','okta','entra','netsuite','healthcare']"
FIRST = (
    "['iam:CreateRole','iam:AttachRolePolicy','sts:AssumeRole','iam:PassRole','lambda:CreateFunction',"
    "'ec2:RunInstances','iam:CreateAccessKey','iam:*','netsuite:TRAN_PURCHORD.full',"
    "'netsuite:TRAN_VENDPYMT.full','netsuite:LIST_VENDOR.edit','netsuite:TRAN_VENDBILL.full',"
    "'netsuite:TRAN_JOURNAL.full','netsuite:ADMI_ACCTPERIODS.full']"
)
AS_OF = "TIMESTAMP '2002-01-01 00:00:00'"
EVENT_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DRIFT_AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"


def days(later: str, earlier: str) -> str:
    """Whole days, floored."""
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


CTES: dict[str, str] = {}

CTES["line"] = "SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"

CTES["subject"] = f"""
SELECT 'S' || c_custkey AS id, 'S' || c_custkey AS external_id,
  {SOURCES}[n_regionkey + 1] AS source,
  CASE c_custkey % 20 WHEN 0 THEN 'service_account' WHEN 1 THEN 'ai_agent' WHEN 2 THEN 'group' ELSE 'human' END AS type,
  CASE WHEN c_custkey % 4 = 0 THEN 'Name ' || CAST(floor(c_custkey / 6) AS BIGINT) ELSE c_name END AS display_name,
  CASE WHEN c_custkey % 5 <> 0 THEN 'U' || CAST(floor(c_custkey / 2) AS BIGINT) || '@Corp.test ' END AS email,
  CASE WHEN c_custkey % 20 <> 2 AND c_custkey % 13 <> 0 THEN c_mktsegment END AS department,
  CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey = 7 THEN 'S70' WHEN c_custkey % 97 = 5 THEN 'S999999999'
       ELSE 'S' || CAST(floor(c_custkey / 10) AS BIGINT) END AS manager_id,
  CASE WHEN c_custkey % 17 = 0 THEN 'deleted' WHEN c_custkey % 17 IN (1, 2) THEN 'inactive'
       WHEN c_custkey % 17 = 3 THEN 'suspended' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 3 <> 0 THEN last_ship END AS last_seen,
  CASE WHEN c_custkey % 20 IN (1, 2) OR c_custkey % 7 = 0 THEN NULL ELSE c_acctbal >= 1000 END AS mfa_enabled,
  CASE WHEN n_regionkey = 0 THEN c_custkey % 40 = 0 END AS trust_policy_open,
  CASE WHEN n_regionkey = 0 THEN c_custkey % 30 = 0 END AS cross_account_trust,
  CASE WHEN n_regionkey = 0 THEN c_custkey % 60 = 0 END AS cross_account_no_conditions,
  c_mktsegment AS segment, first_order AS created_at, c_custkey AS ingest_seq
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, max(l_shipdate) AS last_ship, min(o_orderdate) AS first_order FROM line GROUP BY 1) a
  ON a.o_custkey = c_custkey"""

CTES["part_actions"] = f"""
SELECT p_partkey,
  CASE WHEN p_partkey % 150 < 14 THEN {FIRST}[p_partkey % 150 + 1]
       ELSE 'svc' || (p_size % 7) || ':Op' || (p_partkey % 60) END AS a0,
  'svc' || (p_size % 7) || ':Op' || ((p_partkey * 3 + 7) % 60) AS a1,
  'svc' || (p_size % 7) || ':Op' || ((p_partkey * 3 + 14) % 60) AS a2
FROM part"""

CTES["permission"] = f"""
SELECT 'P' || p.p_partkey AS id, {SOURCES}[p.p_partkey % 5 + 1] AS source,
  CASE WHEN p.p_partkey % 50 = 0 THEN 'Break-Glass ' || p.p_partkey WHEN p.p_partkey % 50 = 1 THEN 'Admin ' || p.p_partkey
       ELSE p_name || ' ' || p.p_partkey END AS name,
  CASE WHEN p.p_partkey % 25 = 1 THEN 'group' WHEN p.p_partkey % 25 < 10 THEN 'role' ELSE 'policy' END AS type,
  (p_size >= 45 OR p.p_partkey % 50 IN (0, 1)) AS is_privileged,
  CASE WHEN p.p_partkey % 150 BETWEEN 8 AND 13 THEN split_part(split_part(a0, ':', 2), '.', 1) END AS permission_key,
  CASE WHEN p.p_partkey % 50 = 3 THEN 'SOS-Admin' END AS tag,
  p.p_partkey AS k, a0, a1, a2
FROM part p JOIN part_actions USING (p_partkey)"""

CTES["permission_action"] = """
SELECT id AS permission_id, 0 AS pos, a0 AS action FROM permission
UNION ALL SELECT id, 1, a1 FROM permission UNION ALL SELECT id, 2, a2 FROM permission"""

CTES["permission_resource"] = """
SELECT 'P' || p_partkey AS permission_id, 'arn:res:' || (p_partkey % 97) AS resource_string FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT 'P' || p_partkey, 'Supplier#' || lpad(CAST(p_partkey % 97 AS VARCHAR), 9, '0') FROM part WHERE p_partkey % 8 = 0
UNION ALL SELECT 'P' || p_partkey, 'Supplier#' || lpad(CAST(p_partkey % 89 AS VARCHAR), 9, '0') FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT 'P' || p_partkey, '*' FROM part WHERE p_partkey % 4 = 2"""

CTES["resource"] = f"""
SELECT 'R' || s_suppkey AS id, {SOURCES}[s_suppkey % 5 + 1] AS source, s_name AS name, 'arn:res:' || s_suppkey AS arn,
  CASE WHEN s_suppkey % 10 = 0 THEN 'critical' WHEN s_suppkey % 10 IN (1, 2) THEN 'high'
       WHEN s_suppkey % 10 IN (3, 4, 5) THEN 'medium' ELSE 'low' END AS sensitivity
FROM supplier"""

CTES["assignment"] = """
SELECT 'A' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
  'S' || o_custkey AS subject_id, 'P' || l_partkey AS permission_id,
  CASE WHEN l_linenumber = 1 AND l_quantity <= 5 THEN 'R' || l_suppkey END AS resource_id,
  'bound' AS source, o_orderdate AS granted_at,
  CASE l_linenumber WHEN 1 THEN 'okta' WHEN 2 THEN 'admin@corp.test' WHEN 3 THEN 'auto-prov' WHEN 4 THEN 'system' END AS granted_by,
  CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS last_used,
  l_linestatus = 'O' AS is_active,
  CASE WHEN l_linenumber = 4 THEN 'ticket' END AS justification
FROM line"""

CTES["event"] = """
SELECT CAST(event_id AS VARCHAR) AS id, 'bound' AS source, ts,
  CASE event_type WHEN 'signup' THEN 'iam.create_user' WHEN 'click' THEN 'access.read' WHEN 'view' THEN 'access.list'
                  WHEN 'purchase' THEN 'access.write' WHEN 'error' THEN 'auth.login' END AS event_type,
  'svc' || (event_id % 7) || ':Op' || (event_id % 60) AS raw_event_name, 'S' || user_id AS actor_id,
  event_type <> 'error' AS success, '10.0.0.' || json_extract_string(props, '$.k') AS source_ip
FROM events"""

# --- shared steps ------------------------------------------------------------
CTES["sp"] = """
SELECT DISTINCT a.subject_id, a.permission_id FROM assignment a JOIN permission p ON a.permission_id = p.id WHERE a.is_active"""
CTES["sa"] = """
SELECT DISTINCT sp.subject_id, pa.action FROM sp JOIN permission_action pa USING (permission_id)"""
CTES["perm_counts"] = """
SELECT s.id AS subject_id, count(sp.permission_id) AS total_permissions,
  count(CASE WHEN p.is_privileged THEN 1 END) AS privileged_permissions
FROM subject s LEFT JOIN sp ON sp.subject_id = s.id LEFT JOIN permission p ON p.id = sp.permission_id GROUP BY 1"""
CTES["peer"] = """
SELECT s.id AS subject_id, lower(trim(coalesce(nullif(department, ''), 'unknown'))) AS peer_department, type AS peer_type,
  total_permissions AS n
FROM subject s JOIN perm_counts c ON c.subject_id = s.id WHERE type <> 'group'"""
CTES["peer_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY peer_department, peer_type ORDER BY n) AS rn,
  count(*) OVER (PARTITION BY peer_department, peer_type) AS group_size FROM peer"""
CTES["peer_stats"] = """
SELECT peer_department, peer_type, max(group_size) AS group_size,
  CASE WHEN max(group_size) < 2 THEN 1.0
       ELSE CAST(max(CASE WHEN rn = CAST(floor(group_size / 2) AS BIGINT) + 1 THEN n END) AS DOUBLE) END AS upper_median,
  avg(n) AS peer_mean, stddev_pop(n) AS peer_std FROM peer_ranked GROUP BY 1, 2"""
CTES["peer_ratio"] = """
SELECT s.id AS subject_id, CASE WHEN s.type = 'group' THEN CAST(c.total_permissions AS DOUBLE)
   WHEN upper_median > 0 THEN c.total_permissions / upper_median ELSE 1.0 END AS ratio
FROM subject s JOIN perm_counts c ON c.subject_id = s.id LEFT JOIN peer p ON p.subject_id = s.id
LEFT JOIN peer_stats st ON st.peer_department = p.peer_department AND st.peer_type = p.peer_type"""
CTES["member_key"] = """
SELECT id AS subject_id, source, 'mail:' || trim(lower(email)) AS key FROM subject WHERE type <> 'group' AND email <> ''
UNION ALL SELECT id, source, 'name:' || replace(trim(lower(display_name)), '  ', ' ') FROM subject
WHERE type <> 'group' AND trim(display_name) <> ''"""
CTES["member_link"] = """
SELECT k.subject_id, k.key FROM member_key k JOIN (SELECT key FROM member_key GROUP BY key HAVING count(*) > 1
  AND (key LIKE 'mail:%' OR count(DISTINCT source) > 1)) x ON x.key = k.key"""
CTES["member_reach"] = """
SELECT id AS subject_id, id AS other FROM subject WHERE type <> 'group'
UNION SELECT r.subject_id, b.subject_id FROM member_reach r JOIN member_link a ON a.subject_id = r.other
  JOIN member_link b ON b.key = a.key"""
CTES["component"] = "SELECT subject_id, min(other) AS component_id FROM member_reach GROUP BY 1"
CTES["component_span"] = """
SELECT component_id, count(DISTINCT s.source) AS source_count, string_agg(DISTINCT s.source, ',' ORDER BY s.source) AS sources
FROM component c JOIN subject s ON s.id = c.subject_id GROUP BY 1 HAVING count(DISTINCT s.source) > 1"""
CTES["member"] = """
SELECT c.subject_id, c.component_id, source_count, sources, s.source, s.type, s.status, s.department, s.display_name, s.email, s.ingest_seq
FROM component c JOIN component_span x ON x.component_id = c.component_id JOIN subject s ON s.id = c.subject_id"""
CTES["unit"] = """
SELECT s.id AS subject_id, coalesce(m.component_id, s.id) AS unit_id, coalesce(m.sources, s.source) AS sources,
  coalesce(m.source_count, 1) AS source_count
FROM subject s LEFT JOIN member m ON m.subject_id = s.id"""
CTES["by_source"] = """
SELECT component_id, source, arg_max(status, ingest_seq) AS status,
  arg_max(department, ingest_seq) FILTER (WHERE department <> '') AS department,
  arg_max(trim(lower(display_name)), ingest_seq) AS name FROM member GROUP BY 1, 2"""
CTES["by_component"] = """
SELECT component_id, count(DISTINCT status) AS statuses, count(department) AS department_sources,
  count(DISTINCT department) AS departments, count(DISTINCT name) AS names,
  string_agg(source, ',' ORDER BY source) AS sources,
  string_agg(CASE WHEN department IS NOT NULL THEN source END, ',' ORDER BY source) AS department_in,
  string_agg(CASE WHEN status = 'deleted' THEN source END, ',' ORDER BY source) AS deleted_in,
  string_agg(CASE WHEN status = 'active' THEN source END, ',' ORDER BY source) AS active_in
FROM by_source GROUP BY 1"""
CTES["pair"] = """
SELECT * FROM (VALUES (0, 'TRAN_PURCHORD', 'TRAN_VENDPYMT'), (1, 'LIST_VENDOR', 'TRAN_VENDBILL'),
 (2, 'TRAN_VENDBILL', 'TRAN_VENDPYMT'), (3, 'TRAN_JOURNAL', 'ADMI_ACCTPERIODS'),
 (4, 'TRAN_CUSTPYMT', 'TRAN_INVOICE'), (5, 'LIST_ACCOUNT', 'TRAN_JOURNAL')) t(pair_no, key_a, key_b)"""
CTES["subject_key"] = """
SELECT subject_id, CASE WHEN action LIKE 'netsuite:%' THEN split_part(split_part(action, ':', 2), '.', 1) ELSE action END AS key FROM sa
UNION SELECT sp.subject_id, p.permission_key FROM sp JOIN permission p ON p.id = sp.permission_id WHERE p.permission_key IS NOT NULL"""
CTES["unit_key"] = "SELECT DISTINCT u.unit_id, k.key FROM subject_key k JOIN unit u ON u.subject_id = k.subject_id"
CTES["violation"] = """
SELECT a.unit_id, pair.pair_no, key_a, key_b FROM pair JOIN unit_key a ON a.key = key_a
JOIN unit_key b ON b.key = key_b AND b.unit_id = a.unit_id"""
CTES["pattern"] = """
SELECT * FROM (VALUES (0, 'iam:CreateRole', 3, 0.99), (0, 'iam:AttachRolePolicy', 3, 0.99), (0, 'sts:AssumeRole', 3, 0.99),
 (1, 'iam:CreateRole', 3, 0.99), (1, 'iam:PutRolePolicy', 3, 0.99), (1, 'sts:AssumeRole', 3, 0.99),
 (2, 'iam:CreateUser', 2, 0.90), (2, 'iam:AttachUserPolicy', 2, 0.90),
 (3, 'iam:PassRole', 2, 0.85), (3, 'lambda:CreateFunction', 2, 0.85),
 (4, 'iam:PassRole', 2, 0.85), (4, 'ec2:RunInstances', 2, 0.85),
 (5, 'iam:CreateAccessKey', 1, 0.80), (6, 'iam:UpdateAssumeRolePolicy', 1, 0.75)) t(pattern_no, action, size, confidence)"""
CTES["path"] = """
SELECT sa.subject_id, pattern_no, CAST(max(p.confidence) AS DOUBLE) AS confidence, max(p.size) AS steps, max(s.source) AS source
FROM pattern p JOIN sa ON sa.action = p.action OR sa.action = split_part(p.action, ':', 1) || ':*' OR sa.action = '*'
JOIN subject s ON s.id = sa.subject_id
GROUP BY sa.subject_id, pattern_no HAVING count(DISTINCT p.action) = max(p.size)"""
CTES["grant"] = """
SELECT DISTINCT permission_id, resource_id FROM (
  SELECT pr.permission_id, r.id AS resource_id FROM permission_resource pr
  JOIN resource r ON (r.arn = pr.resource_string OR r.name = pr.resource_string) WHERE pr.resource_string <> '*'
  UNION ALL SELECT permission_id, resource_id FROM assignment WHERE resource_id IS NOT NULL)"""
CTES["edge"] = """
SELECT 'subject:' || manager_id AS src, 'subject:' || id AS dst, 'manages' AS edge_type FROM subject WHERE manager_id IS NOT NULL
UNION SELECT 'subject:' || subject_id, 'permission:' || permission_id, 'has_permission' FROM assignment
UNION SELECT 'permission:' || permission_id, 'resource:' || resource_id, 'grants_access' FROM "grant" """
CTES["declared"] = """
SELECT 'subject:' || id AS node, 'subject' AS node_type FROM subject
UNION SELECT 'permission:' || id, 'permission' FROM permission UNION SELECT 'resource:' || id, 'resource' FROM resource"""
CTES["node"] = """
SELECT e.node, coalesce(d.node_type, 'unknown') AS node_type FROM
 (SELECT node FROM declared UNION SELECT src FROM edge UNION SELECT dst FROM edge) e LEFT JOIN declared d ON d.node = e.node"""
CTES["reach"] = """
SELECT DISTINCT a.subject_id, g.resource_id FROM (SELECT DISTINCT subject_id, permission_id FROM assignment) a
JOIN "grant" g ON g.permission_id = a.permission_id JOIN resource r ON r.id = g.resource_id"""
CTES["critical_reach"] = """
SELECT a.subject_id, count(*) AS n FROM (SELECT DISTINCT subject_id, permission_id FROM assignment) a
JOIN "grant" g ON g.permission_id = a.permission_id JOIN resource r ON r.id = g.resource_id AND r.sensitivity = 'critical' GROUP BY 1"""
CTES["distance"] = """
SELECT 'resource:' || id AS node, 0 AS distance FROM resource WHERE sensitivity = 'critical'
UNION SELECT e.src, d.distance + 1 FROM distance d JOIN edge e ON e.dst = d.node WHERE d.distance < 12"""
CTES["walk"] = """
SELECT id AS subject_id, manager_id AS cur, [id] AS visited, 1 AS hops FROM subject WHERE manager_id IS NOT NULL
UNION ALL SELECT w.subject_id, s.manager_id, list_append(w.visited, w.cur), w.hops + 1
FROM walk w JOIN subject s ON s.id = w.cur WHERE s.manager_id IS NOT NULL AND NOT list_contains(w.visited, s.manager_id) AND w.hops < 20"""
CTES["drift_pair"] = f"""
SELECT subject_id, permission_id, """ + ", ".join(
    f"bool_or(granted_at <= {DRIFT_AS_OF} - INTERVAL {w} DAY AND (is_active OR coalesce(last_used > {DRIFT_AS_OF} - INTERVAL {w} DAY, false))) AS t{w}"
    for w in (0, 7, 30, 90)
) + " FROM assignment GROUP BY 1, 2"
CTES["drift"] = """
SELECT subject_id, """ + ", ".join(
    f"count(CASE WHEN t0 AND NOT t{w} THEN 1 END) AS permissions_added_{w}d, "
    f"count(CASE WHEN t{w} AND NOT t0 THEN 1 END) AS permissions_removed_{w}d"
    for w in (7, 30, 90)
) + """, (count(CASE WHEN t0 AND NOT t90 THEN 1 END) - count(CASE WHEN t90 AND NOT t0 THEN 1 END))
  / CAST(greatest(count(CASE WHEN t90 THEN 1 END), 1) AS DOUBLE) AS net_drift_rate
FROM drift_pair GROUP BY 1"""
CTES["recent"] = f"SELECT * FROM event WHERE ts > {EVENT_AS_OF} - INTERVAL 30 DAY AND ts <= {EVENT_AS_OF}"
CTES["login_hours"] = "SELECT actor_id, hour(ts) AS h, count(*) AS n FROM recent WHERE event_type = 'auth.login' GROUP BY 1, 2"
CTES["login_entropy"] = """
SELECT actor_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM login_hours GROUP BY 1"""
CTES["activity"] = """
SELECT r.actor_id AS subject_id, count(*) / 30.0 AS avg_daily_api_calls_30d, count(DISTINCT source_ip) AS distinct_source_ips_30d,
  coalesce(max(e.entropy), 0.0) AS login_time_entropy
FROM recent r JOIN subject s ON s.id = r.actor_id LEFT JOIN login_entropy e ON e.actor_id = r.actor_id GROUP BY 1"""
CTES["usage"] = """
SELECT sa.subject_id, count(e.action) / CAST(count(*) AS DOUBLE) AS usage_ratio FROM sa
LEFT JOIN (SELECT DISTINCT actor_id, raw_event_name AS action FROM event) e ON e.actor_id = sa.subject_id AND e.action = sa.action
GROUP BY 1"""
CTES["sod_count"] = """
SELECT u.subject_id, count(*) AS n FROM unit u JOIN violation v ON v.unit_id = u.unit_id GROUP BY 1"""
CTES["consistency"] = """
SELECT component_id, greatest(0::DOUBLE, 1::DOUBLE - CASE WHEN count(DISTINCT status) > 1 THEN 0.4::DOUBLE ELSE 0::DOUBLE END
  - CASE WHEN count(DISTINCT nullif(department, '')) > 1 THEN 0.3::DOUBLE ELSE 0::DOUBLE END
  - CASE WHEN count(DISTINCT trim(lower(display_name))) > 1 THEN 0.2::DOUBLE ELSE 0::DOUBLE END) AS score FROM member GROUP BY 1"""
CTES["feature"] = f"""
SELECT s.id AS subject_id, s.source, s.type, s.status, coalesce(s.department, 'unknown') AS department,
  coalesce({days(AS_OF, 's.created_at')}, 0) AS account_age_days,
  coalesce({days(AS_OF, 's.last_seen')}, -1) AS days_since_last_activity,
  CASE WHEN s.mfa_enabled IS NULL THEN 0.5 WHEN s.mfa_enabled THEN 1.0 ELSE 0.0 END AS mfa_usage_rate,
  c.total_permissions, c.privileged_permissions, r.ratio AS permission_to_peer_median_ratio,
  coalesce(m.source_count, 1) AS source_system_count,
  coalesce(u.usage_ratio, 0.0) AS usage_ratio, coalesce(a.avg_daily_api_calls_30d, 0.0) AS avg_daily_api_calls_30d,
  coalesce(a.distinct_source_ips_30d, 0) AS distinct_source_ips_30d, coalesce(a.login_time_entropy, 0.0) AS login_time_entropy,
  coalesce(d.permissions_added_30d, 0) AS permissions_added_30d, coalesce(d.permissions_removed_30d, 0) AS permissions_removed_30d,
  coalesce(d.permissions_added_90d, 0) AS permissions_added_90d, coalesce(d.permissions_removed_90d, 0) AS permissions_removed_90d,
  coalesce(d.net_drift_rate, 0.0) AS net_drift_rate,
  coalesce(sc.n, 0) AS sod_pair_membership_count, coalesce(cs.score, 1.0) AS cross_system_consistency_score,
  s.trust_policy_open
FROM subject s JOIN perm_counts c ON c.subject_id = s.id JOIN peer_ratio r ON r.subject_id = s.id
LEFT JOIN member m ON m.subject_id = s.id LEFT JOIN usage u ON u.subject_id = s.id LEFT JOIN activity a ON a.subject_id = s.id
LEFT JOIN drift d ON d.subject_id = s.id LEFT JOIN sod_count sc ON sc.subject_id = s.id
LEFT JOIN consistency cs ON cs.component_id = m.component_id"""

# CTEs used more than once below a query are computed once.
STORED = {"line", "subject", "permission", "permission_action", "assignment", "sp", "sa", "component", "member", "unit", "path", "grant", "edge", "feature", "violation", "subject_key"}


def tables_of(text: str) -> set[str]:
    """Names that follow FROM or JOIN."""
    return set(re.findall(r'(?:FROM|JOIN)\s+"?([A-Za-z_][A-Za-z_0-9]*)', text))


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH RECURSIVE`` prefix holding the CTEs that ``body`` needs, then ``body``."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str, inside: tuple[str, ...]) -> None:
        for name in sorted(tables_of(text) & set(known)):
            if name in inside or name in needed:
                continue
            visit(known[name], (*inside, name))
            needed.append(name)

    visit(body, ())
    parts = []
    for name in needed:
        recursive = name in tables_of(known[name])
        stored = "" if recursive else ("MATERIALIZED " if name in STORED or name in (extra or {}) else "")
        parts.append(f'"{name}" AS {stored}({known[name].strip()})')
    prefix = f"WITH RECURSIVE {', '.join(parts)}\n" if parts else ""
    return prefix + body.strip()
