import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import topk


def plain(rows, k):
    whole = [
        (i, [math.floor(1024 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q, a in whole:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("leaf", [4, 128])
def test_matches_a_plain_version(spark, monkeypatch, leaf):
    monkeypatch.setattr(topk, "LEAF", leaf)
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(0, 0.3, 6)]) for i in range(500)]
    # Ties, equal vectors, nulls, non-finite components, another length, a large component.
    rows += [(500 + i, rows[7][1]) for i in range(20)] + [(600, rows[7][1]), (700, [0.0] * 6)]
    rows += [(800, None), (801, [None] * 6), (802, [float("nan")] + [0.0] * 5), (803, [float("inf")] + [0.0] * 5), (804, [])]
    rows += [(900, [1.0, 2.0]), (901, [2.0, 1.0]), (902, [-1.0, 3.0]), (None, [0.1] * 6), (1000, [1e6] + [0.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = topk.top_k(table, F.col("vec_id") % 100 == 0, 10).collect()
    assert {tuple(r) for r in got} == plain(rows, 10)
    assert len(got) == len(plain(rows, 10))


def test_blocks_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    draw = np.random.default_rng(6)
    rows = [(i * 25, [float(np.float32(x)) for x in draw.normal(0, 1, 3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 100 == 0, 3).collect()} == plain(rows, 3)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_products_beyond_doubles_stay_exact():
    big = np.array([[2**40, 1], [2**40, 2]], dtype=np.int64)
    assert topk.exact_type(big, big) is object
    tree = topk.Tree(np.array([1, 2]), big.astype(object))
    assert sorted(tree.search(big[0].astype(object), 9, 2, -math.inf), reverse=True) == [(2**80 + 2, 2), (2**80 + 1, 1)]
