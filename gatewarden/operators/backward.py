"""Exact betweenness of subjects, followed back from the ends of the paths.

In the identity graph subjects lead to subjects and to permissions, permissions lead to resources, and
nothing leads back. The links among subjects are few, so every worker gets them; the other vertices are
dealt out as targets. From a target's holders all shortest paths are followed back over the links among
subjects, level by level, and the dependencies come forward again over the same levels. What is
exchanged is a row per held permission and per link from a permission to a resource, and never a row per
source and vertex it reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewarden.plans.durable import materialize
from gatewarden.plans.joins import skew_join
from gatewarden.plans.workers import importable

#: Links among subjects that are sent to all workers, and subjects, at most.
MOST_LINKS, MOST_SUBJECTS = 4_000_000, 16_000_000
#: Rows that a step may expand to before its targets are halved (a single target may need more).
MOST_ROWS = 1_000_000
#: Holders counted once per resource: what a block of resources has to expand, about.
BLOCK_WEIGHT = 4_000_000
#: Held permissions in a block, about.
BLOCK_ROWS = 300_000
SUMS = "vertex long, delta double"
#: Sums, or the holders of a permission as packed places.
HELD = f"{SUMS}, mid long, holders long, places binary"


class Subjects:
    """Links among subjects by their end: a subject's place is its number less the smallest."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.low = int(min(src.min(), dst.min())) if len(src) else 0
        self.width = int(max(src.max(), dst.max())) - self.low + 1 if len(src) else 1
        order = np.argsort(dst, kind="stable")
        self.before = (src[order] - self.low).astype(np.int32)
        self.many = np.bincount(dst - self.low, minlength=self.width)
        self.first = np.cumsum(self.many) - self.many
        self.linked = self.many > 0
        self.linked[self.before] = True

    def places(self, vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vertices with a link to or from a subject, and which vertices these are."""
        place = vertices - self.low
        kept = np.flatnonzero((place >= 0) & (place < self.width))
        kept = kept[self.linked[place[kept]]]
        return place[kept], kept


def _contained(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def add_dependencies(graph: Subjects, key: np.ndarray, distance: np.ndarray, paths: np.ndarray, totals: np.ndarray) -> None:
    """Add to ``totals``, by place, the dependencies of all sources on all subjects on the way to the given targets.

    A start is a subject that a target is seen from: ``key`` is target * width + place, with the distance between
    the two and the number of shortest paths. A target that is itself a subject starts at distance 0, with one path.
    """
    width, found, steps = graph.width, [], []
    seen = ahead = np.empty(0, np.int64)
    ahead_from, ahead_paths = ahead, np.empty(0)
    at, last = (int(distance.min()), int(distance.max())) if len(key) else (0, -1)
    start = at
    while at <= last or len(ahead):
        now = distance == at
        keys = np.concatenate([ahead, key[now]])
        fresh = ~_contained(keys, seen)
        reached, where = np.unique(keys[fresh], return_inverse=True)
        sigma = np.bincount(where, weights=np.concatenate([ahead_paths, paths[now]])[fresh], minlength=len(reached))
        onward = fresh[: len(ahead)]
        if found:
            steps.append((ahead_from[onward], where[: np.count_nonzero(onward)]))
        found.append((reached, sigma))
        seen = np.sort(np.concatenate([seen, reached]))
        place = reached % width
        many = graph.many[place]
        total = int(many.sum())
        if total > MOST_ROWS and key.max() // width > key.min() // width:
            target = key // width
            late = target > (int(target.min()) + int(target.max())) // 2
            for part in (~late, late):
                add_dependencies(graph, key[part], distance[part], paths[part], totals)
            return
        ahead_from = np.repeat(np.arange(len(reached)), many)
        ahead = (reached - place)[ahead_from] + graph.before[
            np.arange(total) + np.repeat(graph.first[place] - (np.cumsum(many) - many), many)
        ]
        ahead_paths = sigma[ahead_from]
        at += 1
    if not found:
        return
    delta = np.zeros(len(found[-1][0]))
    for level in reversed(range(len(steps))):
        near, far = steps[level]
        reached, sigma = found[level]
        share = (1.0 + delta) / found[level + 1][1]
        delta = np.bincount(near, weights=share[far], minlength=len(reached)) * sigma
        if start + level > 0:
            np.add.at(totals, reached % width, delta)


def _sums(graph: Subjects, totals: np.ndarray) -> pa.Table:
    at = np.flatnonzero(totals)
    return pa.table({"vertex": at + graph.low, "delta": totals[at]})


def _to_subjects(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = sent.value
        totals = np.zeros(graph.width)
        for batch in batches:
            place = batch.column(0).to_numpy()
            place = place[graph.many[place] > 0]
            key = np.arange(len(place)) * graph.width + place
            add_dependencies(graph, key, np.zeros(len(key), np.int64), np.ones(len(key)), totals)
        yield from _sums(graph, totals).to_batches()

    return run


def _to_permissions(sent) -> Callable:
    def run(block: pa.Table) -> pa.Table:
        graph = sent.value
        mids, holder = block.column("dst").to_numpy(), block.column("src").to_numpy()
        place, kept = graph.places(holder)
        order = np.lexsort((place, mids[kept]))
        place, mids = place[order], mids[kept][order]
        named, first, many = np.unique(mids, return_index=True, return_counts=True)
        totals = np.zeros(graph.width)
        key = np.repeat(np.arange(len(named)), many) * graph.width + place
        add_dependencies(graph, key, np.ones(len(key), np.int64), np.ones(len(key)), totals)
        sums = _sums(graph, totals)
        packed = place.astype(np.int32)
        rows = [packed[a : a + n].tobytes() for a, n in zip(first, many, strict=True)]
        empty = lambda n, kind: pa.nulls(n, kind)
        return pa.table(
            {
                "vertex": pa.chunked_array([sums.column("vertex").combine_chunks(), empty(len(rows), pa.int64())]),
                "delta": pa.chunked_array([sums.column("delta").combine_chunks(), empty(len(rows), pa.float64())]),
                "mid": pa.chunked_array([empty(len(sums), pa.int64()), pa.array(named, pa.int64())]),
                "holders": pa.chunked_array([empty(len(sums), pa.int64()), pa.array(many, pa.int64())]),
                "places": pa.chunked_array([empty(len(sums), pa.binary()), pa.array(rows, pa.binary())]),
            }
        )

    return run


def _to_resources(sent) -> Callable:
    def run(links: pa.Table, held: pa.Table) -> pa.Table:
        graph = sent.value
        totals = np.zeros(graph.width)
        mids = held.column("through").to_numpy()
        order = np.argsort(mids)
        mids, packed = mids[order], held.column("places").take(pa.array(order)).to_pylist()
        many = np.array([len(p) // 4 for p in packed], np.int64)
        first = np.cumsum(many) - many
        places = np.frombuffer(b"".join(packed), np.int32)
        target, mid = links.column("target").to_numpy(), links.column("mid").to_numpy()
        order = np.argsort(target, kind="stable")
        named, number = np.unique(target[order], return_inverse=True)
        row = np.searchsorted(mids, mid[order])

        def holders(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For each row the places of its permission's holders, and which row they are of."""
            n = many[rows]
            of = np.repeat(np.arange(len(rows)), n)
            return places[np.arange(len(of)) + np.repeat(first[rows] - (np.cumsum(n) - n), n)].astype(np.int64), of

        weight = np.bincount(number, weights=many[row], minlength=len(named))
        ends = np.searchsorted(number, np.arange(len(named) + 1))
        a = 0
        while a < len(named):
            room = np.searchsorted(np.cumsum(weight[a:]), MOST_ROWS, side="right")
            b = a + max(1, int(room))
            rows = slice(ends[a], ends[b])
            if b == a + 1:
                counts = np.zeros(graph.width)
                for part in np.array_split(row[rows], 1 + int(weight[a] // MOST_ROWS)):
                    np.add.at(counts, holders(part)[0], 1.0)
                key = np.flatnonzero(counts)
                paths = counts[key]
            else:
                place, of = holders(row[rows])
                key = (number[rows] - a)[of] * graph.width + place
                paths = np.ones(len(key))
            add_dependencies(graph, key, np.full(len(key), 2, np.int64), paths, totals)
            a = b
        return _sums(graph, totals)

    return run


def dependency_sums(links: DataFrame, held: int) -> DataFrame | None:
    """(vertex, delta): every subject's dependencies added up over all sources and targets.

    ``links`` has src, dst, from_subject and to_subject, without loops; ``held`` is the number of those
    from a subject to a permission. None where the links among subjects are too many to be sent.
    """
    spark = links.sparkSession
    importable(spark)
    among = links.where(F.col("from_subject") & F.col("to_subject")).select("src", "dst")
    ends = F.explode(F.array("src", "dst")).alias("v")
    bounds = among.select(ends).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if bounds.n > 2 * MOST_LINKS or (bounds.n and bounds.high - bounds.low >= MOST_SUBJECTS):
        return None
    if not bounds.n:
        return spark.createDataFrame([], SUMS)
    pairs = among.toArrow()
    graph = Subjects(pairs.column("src").to_numpy(), pairs.column("dst").to_numpy())
    sent = spark.sparkContext.broadcast(graph)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = spark.range(0, graph.width, 1, min(parts, 1 + graph.width // 10_000)).toDF("place")
    to_subjects = places.mapInArrow(_to_subjects(sent), SUMS)

    def block(column, blocks: int):
        return F.pmod(F.xxhash64(column), F.lit(blocks))

    blocks = max(parts, held // BLOCK_ROWS)
    grants = links.where(F.col("from_subject") & ~F.col("to_subject")).select(
        "src", "dst", block("dst", blocks).alias("block")
    )
    seen = materialize(grants.groupBy("block").applyInArrow(_to_permissions(sent), HELD), "held-by")
    packed = seen.where(F.col("mid").isNotNull()).select("mid", "holders", "places")
    # Resources that a permission grants together go together, where their permissions' holders are not too many.
    onward = links.where(~F.col("from_subject")).select(F.col("dst").alias("target"), F.col("src").alias("mid"))
    weighed = skew_join(onward, packed.select("mid", "holders"), "mid")
    ends = materialize(
        weighed.groupBy("target").agg(F.sum("holders").alias("weight"), F.min(F.xxhash64("mid")).alias("lead")), "targets"
    )
    weights = ends.groupBy("lead").agg(F.sum("weight").alias("weight"))
    total = int(weights.agg(F.sum("weight")).first()[0] or 0)
    few = max(parts, total // BLOCK_WEIGHT)
    splits = weights.select("lead", F.ceil(F.col("weight") / F.lit(BLOCK_WEIGHT)).alias("splits"))
    split = F.pmod(F.xxhash64("target"), F.col("splits"))
    dealt = ends.join(splits, "lead").select(
        "target", F.when(F.col("splits") > 1, F.xxhash64("lead", split)).otherwise(block("lead", few)).alias("block")
    )
    placed = materialize(skew_join(onward, materialize(dealt, "blocks"), "target"), "resource-blocks")
    wanted = placed.select(F.col("block").alias("side"), F.col("mid").alias("through")).distinct()
    sides = skew_join(wanted, packed.select(F.col("mid").alias("through"), "places"), "through")
    known = skew_join(placed, packed.select("mid"), "mid", "left_semi").select("block", "target", "mid")
    to_resources = known.groupBy("block").cogroup(sides.groupBy("side")).applyInArrow(_to_resources(sent), SUMS)
    sums = to_subjects.unionByName(seen.where(F.col("vertex").isNotNull()).select("vertex", "delta")).unionByName(to_resources)
    return materialize(sums.groupBy("vertex").agg(F.sum("delta").alias("delta")), "betweenness")
