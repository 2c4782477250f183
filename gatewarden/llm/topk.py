"""Exact top-k by inner product with KD-trees per shard.

Vectors become integers (floor of 1024 times each component). Every shard builds a KD-tree:
median splits along the widest side, a tight bounding box per node, leaves of some hundred rows.
A query walks the tree best first: the inner product with a box is at most the sum of
max(q * low, q * high), so nodes come in the order of that bound and the walk ends when the best
bound left is below the k-th score known. That k-th score is propagated: a first pass searches
each query in one shard, and the scores found travel with the query to all shards.

Queries go in blocks of about ``BLOCK`` / 2 rows, one round per block: the block is broadcast to the
shards by a join on the block number, every shard returns at most k rows per query, a window
whose rank limit is applied before the exchange merges them, and the round's result is stored.

Defined results
    null vector, null or non-finite component    takes no part (neither query nor candidate)
    empty vector                                 takes no part
    vectors of other lengths                     only vectors of equal length are compared
    null vec_id                                  takes no part
    repeated rows                                each is a candidate of other ids; rows of the
                                                 query's own id are none, equal queries count once
    fewer than k candidates                      all of them
    ties                                         the smaller vec_id first
    extra columns                                ignored
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewarden.llm.chunks import CHUNK_BYTES
from gatewarden.plans.durable import materialize, materialize_with
from gatewarden.plans.joins import estimated_bytes

#: Queries in a block; 4096 queries of 1000 components are 32 MB.
BLOCK = 4096
LEAF = 128
TREE = "shard int, tree binary"


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    parts = F.col(embedding).cast("array<double>")
    whole = F.col(vec_id).isNotNull() & (F.size(parts) > 0)
    finite = ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(whole & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        # Beyond the range of a long a component keeps the nearest long.
        F.transform(parts, lambda x: F.least(F.greatest(F.floor(1024.0 * x), F.lit(-(2**62))), F.lit(2**62))).alias("v"),
    )


class Tree:
    """A KD-tree over the rows of one shard and one vector length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order, nodes = np.arange(len(ids)), []
        self.ids, self.vectors = ids, vectors

        def build(part: np.ndarray) -> int:
            rows = vectors[part]
            low, high = rows.min(axis=0), rows.max(axis=0)
            me = len(nodes)
            nodes.append([low, high, part, -1, -1])
            if len(part) > LEAF and (high > low).any():
                side = int(np.argmax(high - low))
                middle = len(part) // 2
                by = part[np.argpartition(rows[:, side], middle)]
                nodes[me][2] = None
                nodes[me][3], nodes[me][4] = build(by[:middle]), build(by[middle:])
            return me

        build(order)
        self.low = np.stack([n[0] for n in nodes])
        self.high = np.stack([n[1] for n in nodes])
        self.rows = [n[2] for n in nodes]
        self.children = [(n[3], n[4]) for n in nodes]

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """Best k (score, id) among rows with another id; rows scoring below ``floor`` may be left out."""
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        # Bounds of all boxes at once; a shard has some hundred nodes.
        bounds = self.high @ up + self.low @ down
        frontier = [(-bounds[0], 0)]
        scores, ids = np.empty(0, bounds.dtype), np.empty(0, np.int64)
        while frontier:
            bound, node = heapq.heappop(frontier)
            if -bound < floor:
                break
            rows = self.rows[node]
            if rows is None:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(frontier, (-bounds[child], child))
                continue
            rows = rows[self.ids[rows] != own]
            scores = np.concatenate([scores, self.vectors[rows] @ query])
            ids = np.concatenate([ids, self.ids[rows]])
            if len(scores) > k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
            if len(scores) == k:
                floor = max(floor, scores.min())
        return [(int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]


def exact_type(*sides: np.ndarray) -> type:
    """float64 where all sums of products stay exact in it, else Python integers."""
    most = math.prod(float(np.abs(s).max(initial=0)) for s in sides) * sides[0].shape[1]
    return np.float64 if most < 2**52 else object


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pack(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.record_batch(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def packed(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, vec_id, v, floor) as one compressed row per key and vector length."""

    def pack(table):
        return pa.table(
            {
                key: table.column(key).slice(0, 1),
                "width": pa.array([len(table.column("v")[0])], pa.int32()),
                "packed": pa.array(
                    [_pack({c: table.column(c).combine_chunks() for c in ("vec_id", "v", "floor")})], pa.binary()
                ),
            }
        )

    return rows.groupBy(key, F.size("v").alias("size")).applyInArrow(pack, f"{key} int, width int, packed binary")


FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree_blob, query_blob in zip(batch.column("tree"), batch.column("queries"), strict=True):
                shard, queries = _unpack(tree_blob.as_py()), _unpack(query_blob.as_py())
                vectors, asked = _matrix(shard.column("v").combine_chunks()), _matrix(queries.column("v").combine_chunks())
                kind = exact_type(vectors, asked)
                tree = Tree(shard.column("vec_id").to_numpy(), vectors.astype(kind))
                out = ([], [], [])
                floors = queries.column("floor").to_pylist()
                for own, query, floor in zip(queries.column("vec_id").to_pylist(), asked.astype(kind), floors, strict=True):
                    for score, vec_id in tree.search(query, own, k, -math.inf if floor is None else floor):
                        for column, value in zip(out, (own, vec_id, score), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; Spark limits ranks before the exchange."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of every row that ``is_query``."""
    spark = vectors.sparkSession
    size = estimated_bytes(vectors)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / CHUNK_BYTES) if size < 2**60 else 1)
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    rows = scaled(vectors).withColumns({"shard": place, "floor": F.lit(None).cast("long")})
    trees = materialize(packed(rows, "shard").withColumnRenamed("packed", "tree"), "topk-shards")
    asked = scaled(vectors.where(is_query)).dropDuplicates(["vec_id", "v"])
    # Blocks by id hash; their number follows the count of the queries, so a block has about BLOCK / 2 rows.
    asked, seen = materialize_with(asked, "topk-queries", {"n": F.count(F.lit(1))})
    blocks = max(1, math.ceil(2 * (seen.get("n") or 0) / BLOCK))
    asked = asked.withColumns(
        {"block": F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"), "floor": F.lit(None).cast("long")}
    )
    # First pass: each block in one shard, for a k-th score to start from. No side is broadcast here.
    first = packed(asked.withColumn("shard", F.pmod("block", F.lit(shards))), "shard").withColumnRenamed("packed", "queries")
    started = trees.join(first, ["shard", "width"]).select("tree", "queries")
    floors = best(started.mapInArrow(_search(k), FOUND), k).where(F.col("rank") == k)
    floors = floors.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("floor"))
    known = asked.drop("floor").join(floors, "vec_id", "left").select("block", "vec_id", "v", "floor")
    known = materialize(packed(known, "block"), "topk-blocks")
    found = None
    for block in range(blocks):
        one = F.broadcast(_queries(known.where(F.col("block") == block)))
        tasks = trees.withColumn("block", F.lit(block)).join(one, ["block", "width"]).select("tree", "queries")
        part = best(tasks.mapInArrow(_search(k), FOUND), k)
        part = materialize(part, "topk-found") if blocks > 1 else part
        found = part if found is None else found.union(part)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _queries(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", "width", F.col("packed").alias("queries"))
