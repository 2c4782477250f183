import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gatewarden.llm import simhash as s


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values):
    """Sets of indexes linked by 3 or fewer differing bits."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(values)):
        groups.setdefault(root(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_components_match_a_plain_version(odd_docs):
    rows = odd_docs.collect()
    got = s.components(odd_docs.withColumn("fp", F.lit(1)).withColumn("parts", F.lit(2))).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted(
        (str(r.doc_id), format(plain_fingerprint(r.text), "016x")) for r in rows
    )
    prints = [plain_fingerprint(r.text) for r in rows]
    smallest = {}
    for group in plain_groups(prints):
        ids = [rows[i].doc_id for i in group if rows[i].doc_id is not None]
        for i in group:
            smallest[format(prints[i], "016x")] = min(ids, default=None)
    assert all(r.component_id == smallest[r.fingerprint] for r in got)


def test_empty_table(no_docs):
    assert s.components(no_docs).count() == 0
    assert s.one_per_group(no_docs).count() == 0


def test_trie_join_finds_every_link_at_any_crowd_size(spark, monkeypatch):
    draw = np.random.default_rng(5)
    values = {int(x) for x in draw.integers(0, 2**64, 25, dtype=np.uint64)}
    for x in list(values)[:12]:
        for _ in range(12):
            for bit in draw.integers(0, 64, draw.integers(1, 5)):
                x ^= 1 << int(bit)
            values.add(x)
    # Many fingerprints under one root, at the edges of the value range too.
    values |= {0, 1, 3, 7, 15, 2**64 - 1} | {(1 << 60) | k for k in range(150)}
    values = sorted(values)
    want = plain_groups(values)
    rows = spark.createDataFrame(
        [(int(np.uint64(v).astype(np.int64)), bytearray(v.to_bytes(8, "little"))) for v in values], "vertex long, parts binary"
    )
    place = {int(np.uint64(v).astype(np.int64)): i for i, v in enumerate(values)}
    for crowd in (20_000, 40):
        monkeypatch.setattr(s, "CROWD", crowd)
        forest = s.Forest(len(values))
        for u, v in s.links(rows).collect():
            assert (values[place[u]] ^ values[place[v]]).bit_count() <= 3
            forest.join(place[u], place[v])
        groups = {}
        for i in range(len(values)):
            groups.setdefault(forest.root(i), set()).add(i)
        assert sorted(map(sorted, groups.values())) == want


def test_near_copies_of_one_text_leave_one(spark, sentences):
    base = sentences(77, 400).split()
    rows = [(1, " ".join(base))]
    for i in range(2, 30):
        copy = list(base)
        # Two words changed: overlap of the 5-word shingles about 0.95.
        copy[(i * 13) % 400], copy[(i * 29 + 200) % 400] = f"new{i}", f"other{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, sentences(500 + i, 400)) for i in range(30)]
    rows += [(200, None), (201, ""), (None, "kept without an id"), (100, rows[29][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    left = s.one_per_group(docs)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns
    assert [i for i in ids if i is not None and i < 100] == [1]
    assert {100 + i for i in range(30)} <= set(ids)
    assert 200 in ids and 201 not in ids and None in ids
