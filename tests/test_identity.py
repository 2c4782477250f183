import random

from helpers import as_dict, grant, permission, rows, subject

from gatewarden.operators import identity, sod


def brute_components(people):
    parent = {p["id"]: p["id"] for p in people}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def buckets(key):
        out = {}
        for p in people:
            k = key(p)
            if k:
                out.setdefault(k, []).append(p)
        return out.values()

    def join(group):
        for p in group[1:]:
            a, b = find(group[0]["id"]), find(p["id"])
            if a != b:
                parent[max(a, b)] = min(a, b)

    for g in buckets(lambda p: (p["email"] or "").lower().strip()):
        join(g)
    for g in buckets(lambda p: p["display_name"].lower().strip().replace("  ", " ")):
        if len({p["source"] for p in g}) > 1:
            join(g)
    return {p["id"]: find(p["id"]) for p in people}


def random_people(seed, n=120):
    rnd = random.Random(seed)
    return [
        subject(
            f"s{i:03d}", source=rnd.choice(["aws_iam", "okta", "netsuite"]),
            email=rnd.choice([None, f" U{rnd.randrange(60)}@X.y ", "shared@x.y" if rnd.random() < 0.2 else None]),
            display_name=f"Name  {rnd.randrange(90)}" if rnd.random() < 0.5 else f"own {i}",
            ingest_seq=i, department=rnd.choice([None, "A", "B"]),
        )
        for i in range(n)
    ]


def test_components_equal_union_find(estate_of):
    for seed in (1, 2):
        people = random_people(seed)
        e = estate_of(subject=people)
        got = as_dict(identity.identity_components(e.subject), "subject_id", "component_id")
        want = brute_components(people)
        smallest = {}
        for s, root in want.items():
            smallest[root] = min(s, smallest.get(root, s))
        assert got == {s: smallest[r] for s, r in want.items()}


def test_long_chain_is_one_component(spark):
    n = 200
    order = list(range(n))
    random.Random(4).shuffle(order)
    links = [(f"{max(a, b):04d}", f"{min(a, b):04d}") for a, b in zip(order, order[1:])]
    got = identity.connected_components(spark.createDataFrame(links, "u string, v string")).collect()
    assert len(got) == n and {r["component_id"] for r in got} == {"0000"}


def test_same_source_name_does_not_link_but_mail_does(estate_of):
    e = estate_of(
        subject=[
            subject("a", display_name="Ann"), subject("b", display_name="Ann"),
            subject("c", email="x@y", source="okta"), subject("d", email=" X@Y ", source="okta"),
            subject("e", email="x@y", source="entra"), subject("g", type="group", email="x@y"),
        ]
    )
    got = as_dict(identity.identity_components(e.subject), "subject_id", "component_id")
    assert got == {"a": "a", "b": "b", "c": "c", "d": "c", "e": "c"}
    members = identity.correlated_members(e.subject)
    assert rows(identity.singletons(e.subject, members), "subject_id") == [("a",), ("b",), ("g",)]
    assert rows(members, "subject_id", "source_count") == [("c", 2), ("d", 2), ("e", 2)]


def test_last_subject_of_a_source_speaks_for_it(estate_of):
    e = estate_of(
        subject=[
            subject("a", email="m", source="okta", status="deleted", ingest_seq=1),
            subject("b", email="m", source="okta", status="active", ingest_seq=2),
            subject("c", email="m", source="entra", status="active", ingest_seq=3, department="D"),
        ]
    )
    members = identity.correlated_members(e.subject)
    assert rows(identity.values_by_source(members), "source", "status") == [("entra", "active"), ("okta", "active")]
    profile = identity.inconsistency_profile(members).first()
    assert profile["statuses"] == 1 and profile["department_sources"] == 1
    # The consistency score looks at every subject, not at one per source.
    score = identity.consistency_scores(members).first()["cross_system_consistency_score"]
    assert abs(score - 0.4) < 1e-9  # status and name differ


def test_sod_across_systems(spark, estate_of):
    e = estate_of(
        subject=[subject("a", email="m", source="okta"), subject("b", email="m", source="netsuite"), subject("c")],
        permission=[
            permission("p", ["netsuite:TRAN_PURCHORD.full"]),
            permission("q", ["x:y"], permission_keys=["TRAN_VENDPYMT"]),
            permission("both", ["netsuite:LIST_VENDOR.view", "netsuite:TRAN_VENDBILL.full"]),
        ],
        assignment=[grant("a", "p"), grant("b", "q"), grant("c", "both"), grant("c", "p", is_active=False)],
    )
    members, pairs = identity.correlated_members(e.subject), sod.pair_table(spark)
    got = rows(sod.sod_violation_members(e, members, pairs), "subject_id", "pair_no", "is_cross_boundary")
    assert got == [("a", 0, True), ("b", 0, True), ("c", 1, False)]
    # Declared keys do not count for the assignment flag; one permission may hold both sides.
    assert rows(sod.sod_pair_assignments(e, pairs), "assignment_id") == [("c/both/0",)]


def test_components_group_numbers_by_hash(spark, estate_of):
    people = [subject(f"s{i}", email=f"m{i // 2}@x", source="okta" if i % 2 else "entra") for i in range(8)]
    e = estate_of(subject=people)
    numbers = identity.subject_numbers(e.subject)
    assert sorted((r.subject_id, r.vertex) for r in numbers.collect()) == [(f"s{i}", i) for i in range(8)]
    links = identity.identity_links(e.subject, numbers)
    for table in (links, identity._large_star(links), identity._small_star(links)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    found = {r.subject_id: r.component_id for r in identity.identity_components(e.subject).collect()}
    assert found == {f"s{i}": f"s{i - i % 2}" for i in range(8)}
