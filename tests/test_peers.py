import math
import random

import numpy as np
from helpers import as_dict, grant, permission, subject

from gatewarden.operators import peers


def counts_estate(estate_of, counts, **more):
    top = max(counts.values(), default=0)
    return estate_of(
        subject=[subject(s, **more.get(s, {})) for s in counts],
        permission=[permission(f"p{i}", [f"a{i}"]) for i in range(top)],
        assignment=[grant(s, f"p{i}") for s, n in counts.items() for i in range(n)],
    )


def test_upper_median_for_even_groups(estate_of):
    e = counts_estate(estate_of, {"a": 1, "b": 2, "c": 3, "d": 4})
    stats = peers.peer_statistics(peers.peer_permission_counts(e)).first()
    assert stats["upper_median"] == 3.0
    assert abs(stats["peer_std"] - np.std([1, 2, 3, 4])) < 1e-12
    ratio = as_dict(peers.peer_scores(e), "subject_id", "permission_to_peer_median_ratio")
    assert ratio["d"] == 4 / 3


def test_small_groups_and_zero_median(estate_of):
    e = counts_estate(
        estate_of, {"a": 5, "b": 3, "c": 1, "x": 0, "y": 0, "z": 2},
        a={"department": "one"}, b={"department": "two"}, c={"department": " TWO "},
        x={"department": "three"}, y={"department": "three"}, z={"department": "three"},
    )
    got = {r["subject_id"]: r for r in peers.peer_scores(e).collect()}
    assert got["a"]["permission_to_peer_median_ratio"] == 5.0
    assert got["b"]["peer_group_deviation_score"] == 0.0  # fewer than three peers
    assert got["c"]["permission_to_peer_median_ratio"] == 1 / 3
    assert got["x"]["permission_to_peer_median_ratio"] == 1.0  # median is 0


def test_similarity_equals_direct_computation(estate_of):
    rnd = random.Random(8)
    actions = [f"a{i}" for i in range(9)]
    people = [f"s{i}" for i in range(11)]
    kinds = {s: ("solo" if s == "s0" else rnd.choice(["x", "y"])) for s in people}
    perms = [permission(f"p{i}", rnd.sample(actions, rnd.randrange(0, 4))) for i in range(8)]
    held = {(rnd.choice(people[:-1]), f"p{rnd.randrange(8)}") for _ in range(30)}
    e = estate_of(
        subject=[subject(s, department=kinds[s]) for s in people], permission=perms,
        assignment=[grant(s, p) for s, p in held],
    )
    by_permission = {p["id"]: p["actions"] for p in perms}
    vectors = {s: np.zeros(9) for s in people}
    for s, p in held:
        for a in by_permission[p]:
            vectors[s][actions.index(a)] = 1
    got = as_dict(peers.peer_similarity(e), "subject_id", "peer_group_cosine_similarity")
    for s in people:
        others = [vectors[o] for o in people if o != s and kinds[o] == kinds[s]]
        if not vectors[s].any():
            want = 0.0
        elif not others:
            want = 1.0
        else:
            centre = np.mean(others, axis=0)
            want = 0.0 if not centre.any() else float(vectors[s] @ centre / (np.linalg.norm(vectors[s]) * np.linalg.norm(centre)))
        assert math.isclose(got[s], want, abs_tol=1e-9), s
