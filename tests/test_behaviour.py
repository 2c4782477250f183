import datetime as dt

from gatewarden.operators import behaviour, remediation

NOW = dt.datetime(2024, 1, 31)
AS_OF = "2024-01-31 00:00:00"


def event(i, source, actor, action="svc:Read", kind="access.read", ip="10.0.0.1", payload="{}"):
    return {
        "id": f"e{i}", "source": source, "actor_id": actor, "raw_event_name": action, "event_type": kind,
        "timestamp": NOW - dt.timedelta(hours=i + 1), "source_ip": ip, "success": True, "raw_payload": payload,
    }


def estate(estate_of):
    subjects = [
        {"id": "u1", "source": "aws_iam", "type": "human", "external_id": "arn:aws:iam::1:user/ada", "email": "ada@corp.test"},
        {"id": "u2", "source": "okta", "type": "human", "external_id": "00u2", "email": "Ben@Corp.test ",
         "attributes": '{"login": "ben.login@corp.test"}'},
        {"id": "u3", "source": "entra", "type": "human", "external_id": "guid-3", "email": "cy@corp.test"},
        {"id": "u4", "source": "aws_iam", "type": "human", "external_id": "arn:aws:iam::1:user/twin"},
        {"id": "u5", "source": "aws_iam", "type": "human", "external_id": "arn:aws:iam::2:user/twin"},
    ]
    events = [
        event(0, "aws_cloudtrail", "ada", "s3:GetObject"),
        event(1, "aws_cloudtrail", "arn:aws:iam::1:user/ada", "GetRole", ip="10.0.0.2",
              payload='{"eventSource": "iam.amazonaws.com"}'),
        event(2, "bound", "ada@corp.test", ip="10.0.0.3"),
        event(3, "okta_syslog", "BEN.LOGIN@corp.test", kind="auth.login"),
        event(4, "okta_syslog", "ben@corp.test", kind="auth.login"),
        event(5, "entra_audit", "cy@corp.test"),
        event(6, "aws_cloudtrail", "twin"),
        event(7, "aws_cloudtrail", "arn:aws:iam::2:user/twin"),
    ]
    permissions = [{"id": "p", "actions": ["s3:GetObject", "iam:GetRole", "ec2:RunInstances", "ec2:StopInstances"]}]
    held = [{"id": "a", "subject_id": "u1", "permission_id": "p", "is_active": True}]
    return estate_of(subject=subjects, event=events, permission=permissions, assignment=held)


def test_events_find_their_subjects_under_every_name(estate_of):
    rows = behaviour.activity(estate(estate_of), AS_OF).collect()
    got = {r.subject_id: r for r in rows}
    assert len(rows) == len(got)
    calls = {k: round(r.avg_daily_api_calls_30d * 30) for k, r in got.items()}
    # A name that two users bear means neither; their ids still count.
    assert calls == {"u1": 3, "u2": 2, "u3": 1, "u5": 1}
    assert got["u1"].distinct_source_ips_30d == 3
    assert got["u2"].login_time_entropy == 1.0


def test_usage_matches_actions_of_both_trail_profiles(estate_of):
    (row,) = behaviour.usage_ratios(estate(estate_of)).collect()
    assert (row.subject_id, row.usage_ratio) == ("u1", 0.5)


def test_only_reported_steps_count(spark):
    steps = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 1), ("d", 2)], "signal_id string, step_order int")
    results = spark.createDataFrame([("b", 1, True), ("c", 1, True), ("d", 1, True), ("d", 2, False)], "signal_id string, step_order int, ok boolean")
    got = {r.signal_id: tuple(r)[1:] for r in remediation.execution_ledger(steps, results).collect()}
    assert got == {"a": ("not_run", 0, None), "b": ("running", 1, None), "c": ("completed", 1, None), "d": ("failed", 1, 2)}
    dry = remediation.execution_ledger(steps, results.limit(0), dry_run=True).collect()
    assert {(r.status, r.failed_step) for r in dry} == {("dry_run", None)}


def test_sketches_of_days_merge(spark, estate_of):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    events = [
        {"id": str(i), "source": "x", "actor_id": f"a{i % 3000}", "raw_event_name": None if i % 7 == 0 else f"n{i % 11}", "source_ip": "" if i % 5 == 0 else f"ip{i % 40}",
         "timestamp": start + timedelta(minutes=i * 5), "success": i % 2 == 0, "is_privileged_action": i % 3 == 0}
        for i in range(9000)
    ]
    table = estate_of(event=events).event
    exact = behaviour.event_log_statistics(table).first()
    assert (exact.total_events, exact.unique_subjects, exact.unique_actions, exact.unique_ips) == (9000, 3000, 11, 32)
    assert (exact.error_events, exact.privileged_events) == (4500, 3000)
    days = behaviour.daily_sketches(table)
    merged = behaviour.statistics_of_days(days).first()
    assert abs(merged.unique_subjects - 3000) <= 4 * 0.0082 * 3000 and (merged.unique_actions, merged.unique_ips) == (11, 32)
    assert (merged.total_events, merged.time_range_end) == (9000, exact.time_range_end)
    # A few days are merged from the same stored rows.
    some = behaviour.statistics_of_days(days.where("day < '2024-01-03'")).first()
    assert some.total_events == 2 * 288
    none = behaviour.event_log_statistics(table.limit(0)).first()
    assert (none.total_events, none.unique_subjects, none.time_range_start) == (0, 0, None)
