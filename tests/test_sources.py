import gzip
import json

from helpers import rows
from pyspark.sql import functions as F

from gatewarden.sources import cloud_iam, cloudtrail, directories, erp, identity_logs, posture, tenants

AS_OF = "2002-01-01 00:00:00"


def record(i, **more):
    return {
        "eventID": f"e{i}", "eventTime": "2024-01-15T10:30:45Z", "eventName": "CreateRole",
        "eventSource": "iam.amazonaws.com", "userIdentity": {"type": "IAMUser", "userName": "u"}, **more,
    }


def test_archive_files_gzip_and_bad_ones(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.json").write_text(json.dumps({"Records": [record(1), record(2, eventTime="never")]}))
    with gzip.open(tmp_path / "a" / "b" / "two.json.gz", "wt") as f:
        json.dump({"Records": [record(3, requestParameters={"roleName": "r", "n": {"x": 1}})]}, f)
    (tmp_path / "a" / "zbad.json").write_text('{"Records": [')
    events = cloudtrail.normalise(cloudtrail.read_archive(spark, str(tmp_path)), "archive")
    assert rows(events, "source_event_id", "target_id") == [("e1", ""), ("e2", ""), ("e3", "r")]
    assert rows(cloudtrail.undated(events), "source_event_id") == [("e2",)]
    assert tuple(cloudtrail.file_outcomes(spark, str(tmp_path)).first()) == (2, 1)
    assert cloudtrail.read_archive(spark, str(tmp_path), max_files=1).count() == 1
    assert cloudtrail.read_archive(spark, str(tmp_path), max_events=2).count() == 2


def test_first_files_alone_are_opened(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.json").write_text(json.dumps({"Records": [record(i)]}))
    two = cloudtrail.read_archive(spark, str(tmp_path), max_files=2)
    assert len(two.inputFiles()) == 2 and rows(two, "eventID") == [("e0",), ("e1",)]
    (tmp_path / "none").mkdir()
    assert cloudtrail.read_archive(spark, str(tmp_path / "none"), max_files=2).count() == 0


def test_manifest_opens_files_that_overlap(spark, tmp_path):
    for day in range(10, 20):
        folder = tmp_path / f"day +{day}"
        folder.mkdir()
        lines = [{"uuid": f"{day}-{h}", "published": f"2024-01-{day}T{h:02}:00:00Z"} for h in (1, 12, 23)] + [{"uuid": "x", "published": "never"}]
        (folder / "log.json").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "undated.json").write_text(json.dumps({"uuid": "y"}))
    manifest = identity_logs.manifest_of(spark, str(tmp_path), "okta")
    assert manifest.count() == 11 and manifest.agg({"events": "sum"}).first()[0] == 41
    found = identity_logs.read_range(spark, manifest, "okta", "2024-01-12 12:00:00", "2024-01-13 12:00:00")
    assert len(found.inputFiles()) == 2
    assert rows(found, "uuid") == [("12-12",), ("12-23",), ("13-1",), ("13-12",)]
    assert identity_logs.read_range(spark, manifest, "okta", "2030-01-01 00:00:00", "2030-01-02 00:00:00").count() == 0
    # Only files that came since are read for the next manifest rows.
    (tmp_path / "new.json").write_text(json.dumps({"uuid": "z", "published": "2024-01-13T00:00:00Z"}))
    more = identity_logs.manifest_of(spark, str(tmp_path), "okta", manifest)
    assert [r.events for r in more.collect()] == [1]
    assert identity_logs.manifest_of(spark, str(tmp_path), "okta", manifest.union(more)).count() == 0


def test_one_label_file_feeds_many_tasks(spark, tmp_path):
    from gatewarden.sources import tables

    labels = {f"s{i}": [{"violation_class": c, "label": i % 2, "confidence": 0.5} for c in range(1, 4)] for i in range(4000)}
    labels |= {'quo"ted, {key': [{"violation_class": 9, "label": 1}], "none": []}
    for name, indent in (("a.json", None), ("b.json", 1)):
        (tmp_path / "easy").mkdir(exist_ok=True)
        (tmp_path / "easy" / name).write_text(json.dumps(labels, indent=indent))
    (tmp_path / "hard").mkdir()
    (tmp_path / "hard" / "c.json").write_text(json.dumps({"a]b": [{"violation_class": 1, "label": 1}], "c": [{"violation_class": 2, "label": 0}]}))
    (tmp_path / "hard" / "d.json").write_text(json.dumps({}))
    (tmp_path / "hard" / "e.json").write_text(json.dumps({"s": [{"violation_class": 3, "label": 1}]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = tables.read_labels(spark, str(tmp_path / "easy"), "human")
        assert got.rdd.getNumPartitions() > 4
        wanted = sorted((s, p, e["violation_class"], e["label"]) for s, es in labels.items() for p, e in enumerate(es) for _ in "ab")
        assert rows(got, "subject_id", "pos", "violation_class", "label") == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    hard = tables.read_labels(spark, str(tmp_path / "hard"), "human")
    assert rows(hard, "subject_id", "violation_class", "label") == [("a]b", 1, 1), ("c", 2, 0), ("s", 3, 1)]


def test_dated_archive_prunes_days(spark, tmp_path):
    for day in ("2024-01-14", "2024-01-15", "2024-01-16"):
        folder = tmp_path / f"day={day}"
        folder.mkdir()
        (folder / "x.json").write_text(json.dumps({"Records": [record(day, eventTime=f"{day}T12:00:00Z")]}))
    got = cloudtrail.read_dated_archive(spark, str(tmp_path), "2024-01-15 00:00:00", "2024-01-16 11:59:59")
    assert rows(got, "eventID") == [("e2024-01-15",)]


def test_log_readers_cut_to_range(spark, tmp_path):
    lines = [
        {"uuid": str(i), "eventType": "user.session.start", "published": f"2024-01-0{i}T00:00:00Z",
         "outcome": {"result": "SUCCESS"}, "actor": {"id": "x"}}
        for i in range(1, 5)
    ]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, lines)))
    log = identity_logs.okta_log(spark, str(tmp_path), "2024-01-02 00:00:00", "2024-01-03 00:00:00")
    assert [r["uuid"] for r in log.collect()] == ["2", "3"]
    assert rows(identity_logs.normalise_okta(log), "actor_id", "success") == [("x", True), ("x", True)]


def test_account_pages(spark, tmp_path):
    policy = {"Statement": [{"Effect": "Allow", "Action": "iam:PassRole", "Resource": ["arn:aws:kms::1:key/k", "*"]}]}
    page = {
        "UserDetailList": [
            {"Arn": "arn:aws:iam::1:user/ann", "UserName": "ann", "CreateDate": "2020-01-01T00:00:00+00:00",
             "GroupList": ["g", "none"], "UserPolicyList": [{"PolicyName": "p", "PolicyDocument": policy}]}
        ],
        "GroupDetailList": [
            {"Arn": "arn:aws:iam::1:group/g", "GroupName": "g",
             "AttachedManagedPolicies": [{"PolicyName": "AdministratorAccess", "PolicyArn": "arn:p"}]}
        ],
        "RoleDetailList": [
            {"Arn": "arn:aws:iam::1:role/r", "RoleName": "r", "Tags": [{"Key": "x:type", "Value": "agent"}],
             "AssumeRolePolicyDocument": {"Statement": [
                 {"Effect": "Allow", "Principal": {"AWS": "arn:aws:iam::2:root"}, "Condition": {"a": {"b": "c"}}},
                 {"Effect": "Allow", "Principal": {"Service": "ec2.amazonaws.com"}}]}}
        ],
        "Policies": [
            {"Arn": "arn:p", "PolicyName": "AdministratorAccess",
             "PolicyVersionList": [{"IsDefaultVersion": True, "Document": json.dumps({"Statement": {"Effect": "Allow", "Action": "*", "Resource": "*"}})}]}
        ],
    }
    (tmp_path / "page1.json").write_text(json.dumps(page))
    details = cloud_iam.read_account_details(spark, str(tmp_path))
    e = cloud_iam.account_estate(details, "1")
    assert rows(e.subject, "display_name", "type") == [("ann", "service_account"), ("g", "group"), ("r", "ai_agent")]
    role = e.subject.where("display_name = 'r'").first()
    # The second statement has no conditions and a foreign account was trusted before it.
    assert role["cross_account_trust"] and role["cross_account_no_conditions"] and role["cross_account_ids"] == ["2"]
    assert rows(e.permission, "name", "is_privileged") == [("AdministratorAccess", True), ("p", True)]
    assert rows(e.resource, "name", "sensitivity") == [("key/k", "critical")]
    assert e.assignment.count() == 3
    filled = cloud_iam.with_policy_bodies(e.permission, details["policies"])
    assert filled.where("name = 'AdministratorAccess'").first()["actions"] == ["*"]


def test_policy_files(spark, tmp_path):
    (tmp_path / "A%20b.json").write_text(json.dumps({"PolicyVersion": {"Document": {"Statement": {"Effect": "Allow", "Action": "s3:Get"}}}}))
    (tmp_path / "Deny.json").write_text(json.dumps({"Statement": [{"Effect": "Deny", "Action": "*"}]}))
    got = cloud_iam.directory_permissions(cloud_iam.read_policy_directory(spark, str(tmp_path)))
    assert rows(got, "actions", "is_privileged") == [(["s3:Get"], False)]


def test_sod_audit_document(spark, tmp_path):
    document = {
        "employees": ["Ann Lee", "Bo"], "roles": ["Corp Controller", "AP Clerk", "AP Clerk"],
        "sod_rules": {
            "vendor_pay": {
                "violating_users": ["Ann Lee", "Stranger"],
                "user_roles": [{"name": "Ann Lee", "role": "AP Clerk"}, {"name": "Ann Lee", "role": "Corp Controller"},
                               {"name": "Ann Lee", "role": "AP Clerk"}],
            },
            "customer_refund": {"violating_users": ["Bo"], "user_roles": [{"name": "Bo", "role": "Unlisted"}]},
        },
    }
    (tmp_path / "d.json").write_text(json.dumps(document))
    e = erp.audit_estate(erp.read_audit(spark, str(tmp_path)), AS_OF)
    assert rows(e.subject, "display_name", "department") == [("Ann Lee", "Accounts Payable"), ("Bo", "Finance")]
    assert rows(e.permission, "name", "is_privileged") == [("AP Clerk", False), ("Corp Controller", True)]
    assert e.assignment.count() == 2 and e.resource.count() == 10
    got = e.escalation_path.orderBy("confidence").collect()
    assert [p["confidence"] for p in got] == [0.91, 0.98]
    assert got[1]["steps"][0]["description"] == "Has 'Vendors' via role(s): AP Clerk, Corp Controller"


def test_health_document(spark, tmp_path):
    person = {"id": "P1", "name": "Dr. Ann Lee, RN", "role": "Attending Physician", "department": "ICU", "type": "human",
              "status": "active", "last_login_days_ago": 3, "mfa": True}
    document = {
        "organization": {"facilities": [{"id": "F", "name": "Main", "type": "hospital", "departments": ["ICU", "Psychiatry"]}]},
        "fhir_rbac_roles": [
            {"role": r, "actions": ["read"], "scope": "s", "is_privileged": False, "description": ""}
            for r in ("Attending Physician", "Break-Glass Emergency", "Billing Clerk")
        ],
        "providers": [person], "contractors": [{**person, "id": "C1", "name": "Con", "status": "terminated"}],
        "ai_agents": [{**person, "id": "AI-CODER-001", "name": "Coder", "type": "ai_agent", "role": "Unlisted", "mfa": None}],
        "injected_violations": [
            {"id": "v1", "type": "dormant_contractor", "subject_id": "C1", "description": "text", "severity": "high", "confidence": 0.9,
             "evidence": {"contract_end_date": "2001-01-01", "days_since_contract_end": 365, "active_permissions": ["a", "b"], "mfa_enabled": False}},
            {"id": "v2", "type": "nonsense", "subject_id": "C1", "description": "", "severity": "", "confidence": 0.9, "evidence": {}},
        ],
    }
    (tmp_path / "d.json").write_text(json.dumps(document))
    e = tenants.health_estate(tenants.read_health(spark, str(tmp_path)), AS_OF)
    assert rows(e.subject, "external_id", "email", "status") == [
        ("AI-CODER-001", "ai-coder-001@agents.apexhealth.org", "active"), ("C1", "con@apexhealth.org", "inactive"),
        ("P1", "dr..ann.lee@apexhealth.org", "active"),
    ]
    assert e.assignment.count() == 4  # physician + break-glass, contractor, coder's one known extra role
    assert e.resource.count() == 1 + 2 + 9
    steps = e.escalation_path.first()["steps"]
    assert steps[0]["description"] == "Contract ended 2001-01-01 — 365 days ago"
    assert steps[1]["description"] == "Active permissions: a, b. MFA: DISABLED"


def test_trading_document(spark, tmp_path):
    trader = {"id": "TRAD-006", "name": "Nat Vo", "role": "Trader — Block", "desk": "DESK-BLOCK", "type": "human", "status": "active",
              "last_login_days_ago": 0, "mfa": False}
    document = {
        "firm": {"desks": [{"id": "DESK-EQ", "name": "Equities", "division": "front-office", "asset_class": "e"},
                           {"id": "DESK-BLOCK", "name": "Block", "division": "front-office", "asset_class": "e", "is_restricted": True}],
                 "information_barriers": [{"id": "IB", "name": "Wall", "side_a": ["DESK-BLOCK"], "side_b": ["DESK-EQ"], "regulation": "r"}]},
        "finserv_rbac_roles": [{"role": r, "actions": ["execute_order"]} for r in ("Trader — Block", "Trader — Equities")],
        "personnel": [trader], "terminated_personnel": [], "ai_agents": [],
        "injected_violations": [{"id": "v", "type": "cross_desk_access", "subject_id": "TRAD-006", "description": "d", "confidence": 0.91,
                                 "evidence": {"primary_desk": "B", "additional_access": ["X", "Y"], "justification_on_file": True}}],
    }
    (tmp_path / "d.json").write_text(json.dumps(document))
    source = tenants.read_trading(spark, str(tmp_path))
    e = tenants.trading_estate(source, AS_OF)
    assert rows(e.subject, "department", "email") == [("Block Trading", "nat.vo@apexcapital.com")]
    assert e.assignment.count() == 2
    assert sorted(rows(e.resource, "name", "sensitivity"))[0] == ("Audit Trail", "critical")
    steps = e.escalation_path.first()["steps"]
    assert steps[0]["description"] == "Primary desk: B. Additional access: X, Y"
    assert steps[1]["description"] == "Risk: N/A. Justification: on file"


def test_posture_thresholds(spark):
    admins = spark.createDataFrame(
        [("t", f"a{i}", "A", "Super Administrator", "sms" if i == 0 else "push", "2001-12-31 00:00:00", "active", "human", "IT", None) for i in range(6)]
        + [("t", "old", "O", "Super Administrator", "push", "2001-10-03 00:00:00", "active", "human", "IT", None),
           ("t", "edge", "E", "Read Only Administrator", "sms", "2001-01-01 00:00:00", "active", "human", "IT", None),
           ("t", "svc", "S", "Organization Administrator", "none", "2001-12-31 00:00:00", "active", "service_account", "IT", 91),
           ("t", "svc2", "S", "Report Administrator", "none", "2001-12-31 00:00:00", "active", "service_account", "IT", 400)],
        posture.ADMIN.replace("last_login timestamp", "last_login string"),
    ).withColumn("last_login", F.to_timestamp("last_login"))
    tenants_table = spark.createDataFrame([("t", 720, True)], posture.TENANT)
    got = [r["id"] for r in posture.posture_findings(admins, tenants_table, AS_OF).collect()]
    kinds = sorted(i.split("/")[0] for i in got)
    assert kinds == ["stale-token", "superadmins", "weak-mfa"]  # 90 days are not more than 90


def test_okta_export_folder(spark, tmp_path):
    exports = {
        "users": [{"id": "u1", "status": "LOCKED_OUT", "profile": {"firstName": "A", "lastName": "B"}}],
        "groups": [{"id": "g1", "profile": {"name": "Super users"}}],
        "user_groups": [{"user_id": "u1", "group_id": "g1"}, {"user_id": "u1", "group_id": "gone"}],
        "apps": [{"id": "a1", "label": "Vault"}], "app_links": [{"user_id": "u1", "appInstanceId": "a1", "appName": "v"}],
        "roles": [{"user_id": "u1", "type": "ORG_ADMIN"}], "factors": [{"user_id": "u1", "factorType": "push", "status": "ACTIVE"}],
    }
    for name, lines in exports.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text("\n".join(map(json.dumps, lines)))
    e = directories.okta_estate(directories.read_export(spark, str(tmp_path), directories.OKTA_SCHEMAS))
    assert rows(e.subject, "display_name", "status", "mfa_enabled") == [("A B", "suspended", True)]
    assert rows(e.permission, "name", "is_privileged") == [("App-v", False), ("ORG_ADMIN", True), ("Super users", True)]
    assert e.assignment.count() == 3 and e.resource.first()["sensitivity"] == "critical"


def test_feature_and_label_tables(spark, tmp_path):
    from gatewarden.sources import tables

    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "l.json").write_text(json.dumps({"s": [{"violation_class": 1, "label": 1, "confidence": 0.5}, {"violation_class": 2, "label": 0}]}))
    got = tables.read_labels(spark, str(tmp_path / "labels"), "human")
    assert rows(got, "source", "subject_id", "violation_class", "label") == [("human", "s", 1, 1), ("human", "s", 2, 0)]
    frame = spark.createDataFrame([("a", 1.0)], "subject_id string, x double")
    tables.write_feature_matrix(frame, str(tmp_path / "m"))
    assert tables.read_feature_matrix(spark, str(tmp_path / "m")).count() == 1
    tables.append_audit(frame, str(tmp_path / "audit"))
    tables.append_audit(frame, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    tables.write_metrics(frame, str(tmp_path / "metrics"))


def test_rejects_out_of_range(spark):
    from gatewarden.sources.canonical import reject_out_of_range

    df = spark.createDataFrame([(0.5,), (1.5,), (None,)], "c double")
    good, bad = reject_out_of_range(df, "c", 0.0, 1.0)
    assert good.count() == 1 and bad.count() == 2


def test_archive_files_stay_small_however_many_events(spark, tmp_path, monkeypatch):
    from verification import QUERIES, cases_sources

    monkeypatch.setattr(cases_sources, "ARCHIVE_RECORDS", 100)
    monkeypatch.setattr(cases_sources, "_scratch", lambda b, name: f"file://{tmp_path}/{name}")
    found = QUERIES["cloudtrail_archive_read"](spark, "/root/testdata/sf0.01")
    assert found.select("source_event_id").distinct().count() == found.count() == 10_000
    files = spark.read.option("recursiveFileLookup", True).json(f"file://{tmp_path}/archive")
    assert files.count() == 107 and files.selectExpr("max(size(Records))").first()[0] < 200
