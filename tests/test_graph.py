import random
from collections import defaultdict, deque

from helpers import as_dict, grant, permission, resource, rows, subject

import numpy as np

from gatewarden.operators import backward, graph


def test_manager_depth_walks(spark, estate_of):
    managers = {"a": None, "b": "a", "c": "b", "self": "self", "x": "self", "p": "q", "q": "p", "r": "p", "d": "gone"}
    managers.update({f"n{i}": f"n{i - 1}" for i in range(1, 30)})
    managers["n0"] = None
    e = estate_of(subject=[subject(k, manager_id=v) for k, v in managers.items()])

    def walk(s):
        depth, seen, cur = 0, set(), s
        while depth < 20:
            m = managers.get(cur)
            if cur not in managers or m is None or m in seen:
                break
            seen.add(cur)
            cur, depth = m, depth + 1
        return depth

    got = as_dict(graph.manager_depth(e.subject), "subject_id", "manager_depth")
    assert got == {s: walk(s) for s in managers}


def sample(estate_of):
    return estate_of(
        subject=[subject("s1", manager_id="s2"), subject("s2"), subject("s3", manager_id="ghost"), subject("g", type="group")],
        permission=[
            permission("p1", resources=["arn:1", "*", "missing"]), permission("p2", resources=["R two"]),
            permission("g", type="group"), permission("p3"),
        ],
        resource=[resource("r1", "critical", arn="arn:1"), resource("r2", "critical", name="R two"), resource("r3")],
        assignment=[
            grant("s1", "p1"), grant("s1", "p1", n=1), grant("s1", "p2", is_active=False),
            grant("s2", "p3", resource_id="r1"), grant("s3", "g"), grant("s2", "p1"), grant("s3", "nowhere"),
        ],
        escalation_path=[{"id": "e1", "subject_id": "s2", "steps": [], "confidence": 0.5, "source": "x"}],
    )


def test_edges_and_unknown_nodes(estate_of):
    e = sample(estate_of)
    got = rows(graph.edges(e), "src", "dst", "edge_type")
    assert ("subject:s3", "subject:g", "member_of") in got
    assert ("subject:ghost", "subject:s3", "manages") in got
    assert ("permission:p1", "resource:r1", "grants_access") in got
    assert ("permission:p3", "resource:r1", "grants_access") in got
    kinds = as_dict(graph.nodes(e), "node", "node_type")
    assert kinds["subject:ghost"] == "unknown" and kinds["permission:nowhere"] == "unknown"
    assert len(got) == len({g[:2] for g in got})


def test_membership_replaces_manager_edge(estate_of):
    e = estate_of(
        subject=[subject("s"), subject("g", type="group", manager_id="s")],
        permission=[permission("g", type="group")], assignment=[grant("s", "g")],
    )
    assert ("subject:s", "subject:g", "member_of") in rows(graph.edges(e), "src", "dst", "edge_type")


def test_blast_radius_counts(estate_of):
    e = sample(estate_of)
    got = {r["subject_id"]: r for r in graph.blast_radius(e).collect()}
    # s1 reaches r1 (active) and r2 (inactive assignment counts).
    assert (got["s1"]["direct_resources"], got["s1"]["critical_resources"]) == (2, 2)
    # s2 reaches r1 twice: one resource, two critical entries, plus one path.
    assert (got["s2"]["direct_resources"], got["s2"]["critical_resources"], got["s2"]["total_reach"]) == (1, 2, 2)


def test_degree_with_self_loop(estate_of):
    e = estate_of(subject=[subject("a", manager_id="a"), subject("b")])
    got = as_dict(graph.degree_centrality(e), "subject_id", "degree_centrality")
    assert got == {"a": 2.0, "b": 0.0}
    alone = as_dict(graph.degree_centrality(estate_of(subject=[subject("a")])), "subject_id", "degree_centrality")
    assert alone == {"a": 1.0}


def random_estate(estate_of, seed, n=14):
    rnd = random.Random(seed)
    people = [subject(f"s{i}", manager_id=f"s{rnd.randrange(n)}" if rnd.random() < 0.6 else None) for i in range(n)]
    perms = [permission(f"p{i}", resources=[f"r{rnd.randrange(6)}"]) for i in range(8)]
    things = [resource(f"r{i}", "critical" if i == 2 else "low") for i in range(6)]
    held = [grant(f"s{rnd.randrange(n)}", f"p{rnd.randrange(8)}", n=i) for i in range(18)]
    return estate_of(subject=people, permission=perms, resource=things, assignment=held)


def adjacency(e):
    out, nodes = defaultdict(set), {r["node"] for r in graph.nodes(e).collect()}
    for s, d, _ in rows(graph.edges(e), "src", "dst", "edge_type"):
        out[s].add(d)
    return nodes, out


def test_distance_equals_search(estate_of):
    e = random_estate(estate_of, 1)
    nodes, out = adjacency(e)

    def search(start):
        seen, queue = {start: 0}, deque([start])
        while queue:
            u = queue.popleft()
            if u == "resource:r2":
                return seen[u]
            for v in out[u]:
                if v not in seen:
                    seen[v] = seen[u] + 1
                    queue.append(v)
        return -1

    got = as_dict(graph.distance_to_critical(e), "subject_id", "distance_to_nearest_critical_resource")
    assert got == {f"s{i}": search(f"subject:s{i}") for i in range(14)}


def test_betweenness_equals_brute_force(estate_of):
    e = random_estate(estate_of, 5)
    nodes, out = adjacency(e)

    def paths_from(start):
        dist, sigma, queue = {start: 0}, defaultdict(float, {start: 1.0}), deque([start])
        while queue:
            u = queue.popleft()
            for v in out[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    sigma[v] += sigma[u]
        return dist, sigma

    facts = {u: paths_from(u) for u in nodes}
    score = defaultdict(float)
    for s in nodes:
        for t in nodes:
            if s == t or t not in facts[s][0]:
                continue
            for v in nodes - {s, t}:
                ds, dv = facts[s][0], facts[v][0]
                if v in ds and t in dv and ds[v] + dv[t] == ds[t]:
                    score[v] += facts[s][1][v] * facts[v][1][t] / facts[s][1][t]
    n = len(nodes)
    got = as_dict(graph.betweenness_centrality(e), "subject_id", "betweenness_centrality")
    for i in range(14):
        assert abs(got[f"s{i}"] - score[f"subject:s{i}"] / ((n - 1) * (n - 2))) < 1e-12
    for pairs in (1, 3 * n, 5 * n):
        again = as_dict(graph.betweenness_centrality(e, pairs_per_batch=pairs), "subject_id", "betweenness_centrality")
        assert set(again) == set(got) and all(abs(again[s] - got[s]) < 1e-12 for s in got)


def test_sampled_betweenness_keeps_its_error(estate_of):
    e = random_estate(estate_of, 6)
    numbered = graph.numbered(e)
    exact = as_dict(graph.betweenness_centrality(e, numbered), "subject_id", "betweenness_centrality")
    assert graph.pivots_for(0.05, numbered.n) == numbered.n and graph.pivots_for(0.5, 10**9) < 60
    for seed in (1, 2):
        near = as_dict(graph.betweenness_centrality(e, numbered, error=0.45, seed=seed), "subject_id", "betweenness_centrality")
        assert graph.pivots_for(0.45, numbered.n) < numbered.n
        assert all(abs(near[s] - exact[s]) <= 0.45 for s in exact)


def test_numbers_follow_names(spark, estate_of):
    e = sample(estate_of)
    numbered = graph.numbered(e)
    found = [r["node"] for r in numbered.vertices.orderBy("vertex").collect()]
    assert found == sorted(found) and [r["vertex"] for r in numbered.vertices.orderBy("vertex").collect()] == list(range(numbered.n))
    names = as_dict(numbered.vertices, "vertex", "node")
    links = {(names[s], names[d], t) for s, d, t in rows(numbered.links, "src", "dst", "edge_type")}
    assert links == set(rows(graph.edges(e), "src", "dst", "edge_type"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_group_by_hash_and_make_no_pairs(estate_of):
    e = sample(estate_of)
    for table in (graph.edges(e), graph.nodes(e), graph.reached_words(e, graph.resource_words(e)[0])):
        assert "HashAggregate" in plan_of(table) and "SortAggregate" not in plan_of(table)
    # Before the reach is counted a row is a word of up to 64 resources.
    words = graph.reached_words(e, graph.resource_words(e)[0])
    assert words.columns == ["subject_id", "word", "bits"]


def test_reach_lists(spark, estate_of):
    many = [resource(f"r{i:03}", "critical" if i % 50 == 0 else "low", name=f"n{i}") for i in range(200)]
    perms = [permission("all", resources=[f"n{i}" for i in range(200)]), permission("few", resources=["n0", "n63", "n64", "n199"])]
    e = estate_of(
        subject=[subject("a"), subject("b"), subject("c")], permission=perms, resource=many,
        assignment=[grant("a", "all"), grant("a", "few"), grant("b", "few", is_active=False)],
        escalation_path=[{"id": "e1", "subject_id": "b", "steps": [], "end_result": "admin", "confidence": 0.5, "source": "x"}],
    )
    reach = rows(graph.reachable_resources(e), "subject_id", "resource_id")
    assert reach == sorted([("a", f"r{i:03}") for i in range(200)] + [("b", f"r{i:03}") for i in (0, 63, 64, 199)])
    assert rows(graph.critical_resources(e), "subject_id", "resource_id", "permission_id") == sorted(
        [("a", f"r{i:03}", "all") for i in (0, 50, 100, 150)] + [("a", "r000", "few"), ("b", "r000", "few")]
    )
    assert rows(graph.escalation_resources(e), "subject_id", "path_id", "end_result", "steps") == [("b", "e1", "admin", 0)]
    counts = {r["subject_id"]: tuple(r)[1:] for r in graph.blast_radius(e).collect()}
    assert counts == {"a": (200, 5, 0, 200), "b": (4, 1, 1, 5), "c": (0, 0, 0, 0)}


def test_betweenness_takes_no_pairs_of_source_and_vertex(estate_of, monkeypatch):
    e = random_estate(estate_of, 8)
    by_source = as_dict(graph.betweenness_centrality(e, pairs_per_batch=1 << 30), "subject_id", "betweenness_centrality")
    # Paths are followed back from their ends: no batch of sources is searched.
    monkeypatch.setattr(graph, "_dependencies", None)
    # A block of its own for every few resources.
    monkeypatch.setattr(backward, "BLOCK_WEIGHT", 3)
    got = as_dict(graph.betweenness_centrality(e), "subject_id", "betweenness_centrality")
    assert set(got) == set(by_source) and all(abs(got[s] - by_source[s]) < 1e-12 for s in got)
    assert any(got.values())


def test_targets_are_halved_when_a_step_grows(monkeypatch):
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 40, (120, 2)), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]] + 100
    links = backward.Subjects(pairs[:, 0], pairs[:, 1])
    place = rng.integers(0, links.width, 60)
    key = np.repeat(np.arange(6), 10) * links.width + place
    distance, paths = rng.integers(1, 3, 60), rng.integers(1, 4, 60).astype(float)
    whole, halved = np.zeros(links.width), np.zeros(links.width)
    backward.add_dependencies(links, key, distance, paths, whole)
    monkeypatch.setattr(backward, "MOST_ROWS", 1)
    backward.add_dependencies(links, key, distance, paths, halved)
    assert whole.any() and np.allclose(whole, halved)


def test_reach_and_links_come_from_kept_tables(estate_of):
    e = sample(estate_of)
    kept = e.with_derived(held_edge=graph.held_edges(e), permission_resource=graph.permission_resources(e))
    columns = ("subject_id", "direct_resources", "critical_resources", "escalation_resources", "total_reach")
    # Two permissions lead s1 to a critical resource each, and s2 twice to the same one.
    wanted = [("g", 0, 0, 0, 0), ("s1", 2, 2, 0, 2), ("s2", 1, 2, 1, 2), ("s3", 0, 0, 0, 0)]
    assert rows(graph.blast_radius(e), *columns) == rows(graph.blast_radius(kept), *columns) == wanted
    assert rows(graph.edges(kept), "src", "dst", "edge_type") == rows(graph.edges(e), "src", "dst", "edge_type")
    # Kept tables are what is read.
    none = kept.with_derived(permission_resource=graph.permission_resources(e).where("false"))
    assert {r[2] for r in rows(graph.edges(none), "src", "dst", "edge_type")} == {"manages", "has_permission", "member_of"}
