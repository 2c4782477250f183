"""Near-duplicate groups by 64-bit SimHash, joined by walking binary tries over the fingerprints.

Fingerprint: every shingle of ``size`` words (repeats included, a shorter text is one shingle)
is hashed with XXH64 (seed 42); a bit is set if it is set in over half the hashes.

Self-join: two fingerprints within ``distance`` (3) bits agree in one of ``distance`` + 1 blocks
of 16 bits, so each block value is the root of a trie over the other 48 bits. All node pairs of
a trie are walked together from the root, one bit per level; a pair adds the bits in which its
two prefixes differ and is dropped as soon as they exceed the distance. Only fingerprints that
differ are joined (copies meet in one row before), and a trie returns the links of a spanning
forest of what it found, never all pairs, so thousands of mutual near-copies cost thousands of
rows. A block value that holds more than ``CROWD`` fingerprints is not walked by one task: its
first trie levels are walked by Spark, as rows per node pair, until every part is small.

``components`` takes the strict setting: one 64-bit fingerprint, every pair within 3 bits is linked.
``near_copies`` looks for texts whose sets of 5-word shingles overlap by 0.8 or more, which changes
a sixth of the bits: it takes four fingerprints (256 bits), reaches a pair if any of their 16 blocks
agrees and links it if at most ``WIDE_LIMIT`` of all bits differ. That is probabilistic: measured on
pairs of texts it links all of overlap 0.95 and more, 95 % from 0.90, 88 % from 0.85, 72 % from 0.80,
32 % from 0.75, 7 % from 0.70. Unrelated texts differ in about 128 bits and are never linked.

Defined results
    null text, no words    fingerprint zero, linked like any other
    null doc_id            fingerprinted; never the smallest of a group that has an id
    repeated rows          one result row each, same group
    extra columns          ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gatewarden.operators.identity import connected_components
from gatewarden.plans.durable import materialize, materialize_with

SEED = 42
BITS = 64
#: Fingerprints under one trie root that a single task walks.
CROWD = 20_000
#: Bits of 256 that near-copies may differ in, and bits of the 64 around an agreeing block.
WIDE_LIMIT, WIDE_REACH = 38, 16
WIDE_PARTS = 4
#: Node pairs that a task holds at a time.
FRONTIER = 2_000_000


def shingles(raw: bytes, size: int) -> list[bytes]:
    """The shingles of a text, joined by one space; a shorter text is one, a text without words has none."""
    words = raw.lower().split()
    if not words:
        return []
    text = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    if len(words) <= size:
        return [text]
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    return [text[a:b] for a, b in zip(starts, ends[size - 1 :], strict=True)]


def majority(hashes: np.ndarray, n: int) -> bytes:
    """Bits set in over half of n hashes (rows of bytes)."""
    ones = np.zeros(hashes.shape[1] * 8, np.int64)
    for at in range(0, n, 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)], axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def fingerprint(raw: bytes, size: int) -> bytes:
    """64-bit SimHash of one text (UTF-8), little-endian."""
    found = shingles(raw, size)
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter([hashed(s, SEED) for s in found], "<u8", len(found))
    return majority(hashes.view(np.uint8).reshape(-1, 8), len(found))


def wide_fingerprint(raw: bytes, size: int) -> bytes:
    """256-bit SimHash of one text, of two seeded 128-bit hashes of each shingle."""
    found = shingles(raw, size)
    hashed = xxhash.xxh3_128_digest
    parts = [np.frombuffer(b"".join([hashed(s, seed) for s in found]), np.uint8).reshape(-1, 16) for seed in (1, 2)]
    return majority(np.concatenate(parts, axis=1), len(found))


def fingerprints(docs: DataFrame, size: int = 3, of=fingerprint) -> DataFrame:
    """(doc_id, parts) of every row, ``parts`` the fingerprint's bytes; the text is read once, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = pa.array([of(t.as_py() or b"", size) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "parts"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, parts binary")


def turned(fp: np.ndarray, block: int, width: int) -> np.ndarray:
    """Fingerprints turned so that a block of bits stands first."""
    if not block:
        return fp
    left = np.uint64(block * width)
    return (fp << left) | (fp >> np.uint64(BITS - block * width))


def walk(
    fp: np.ndarray, crowd: np.ndarray, side: np.ndarray, differ: np.ndarray, first: int, distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of ``fp`` within ``distance`` bits of each other, found by walking tries.

    ``fp`` is sorted by (crowd, side, fp). The members of one side agree in the first ``first``
    bits; a crowd with one side is joined with itself, one with two sides (whose prefixes differ in
    ``differ`` bits) across them. A node is a range of positions, divided by the bit of its level.
    """
    starts = _runs(crowd, side)
    ends = np.r_[starts[1:], len(fp)]
    second = np.zeros(len(starts), bool)
    second[1:] = crowd[starts[1:]] == crowd[starts[:-1]]
    crossed = np.r_[second[1:], False] if len(starts) else second
    alone = ~second & ~crossed & (ends - starts > 1)
    zero = np.zeros(alone.sum(), np.int64)
    roots = [
        np.r_[starts[alone], starts[crossed]], np.r_[ends[alone], ends[crossed]],
        np.r_[starts[alone], starts[second]], np.r_[ends[alone], ends[second]],
        np.r_[zero, differ[starts[crossed]]],
    ]
    stack = []
    # Roots in portions, so that the frontier stays small.
    portions = np.cumsum(roots[1] - roots[0]) // 50_000
    for portion in np.unique(portions):
        stack.append((*[r[portions == portion] for r in roots], first))
    while stack:
        a, a_end, b, b_end, differ, bit = stack.pop()
        single = (a_end - a == 1) & (b_end - b == 1)
        if single.any():
            i, j = a[single], b[single]
            near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= distance)
            if near.any():
                yield i[near], j[near]
            rest = ~single
            a, a_end, b, b_end, differ = a[rest], a_end[rest], b[rest], b_end[rest], differ[rest]
        if not len(a):
            continue
        if bit == BITS:
            # No bit is left to divide by: wider fingerprints may agree in this part.
            yield from _equal_pairs(a, a_end, b, b_end)
            continue
        a_mid, b_mid = _split(fp, a, a_end, bit), _split(fp, b, b_end, bit)
        same = (a == b) & (a_end == b_end)
        pairs = [
            (a, a_mid, b, b_mid, differ),
            (a_mid, a_end, b_mid, b_end, differ),
            (a, a_mid, b_mid, b_end, differ + 1),
            # A node paired with itself has this pair already.
            (a_mid, np.where(same, a_mid, a_end), b, b_mid, differ + 1),
        ]
        a, a_end, b, b_end, differ = (np.concatenate(x) for x in zip(*pairs, strict=True))
        alive = (a < a_end) & (b < b_end) & (differ <= distance)
        alive &= ~((a == b) & (a_end == b_end) & (a_end - a == 1))
        a, a_end, b, b_end, differ = a[alive], a_end[alive], b[alive], b_end[alive], differ[alive]
        for at in range(0, len(a), FRONTIER):
            part = slice(at, at + FRONTIER)
            stack.append((a[part], a_end[part], b[part], b_end[part], differ[part], bit + 1))


def _equal_pairs(a, a_end, b, b_end) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs between the ranges of node pairs, some at a time."""
    for low, high, other, other_end in zip(a.tolist(), a_end.tolist(), b.tolist(), b_end.tolist(), strict=True):
        step = max(1, FRONTIER // (other_end - other))
        for at in range(low, high, step):
            i = np.arange(at, min(high, at + step))
            j = np.arange(other, other_end)
            i, j = np.repeat(i, len(j)), np.tile(j, len(i))
            ahead = (i < j) if low == other else np.ones(len(i), bool)
            yield i[ahead], j[ahead]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _split(fp: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """First position in each node whose bit of this level is set; the prefix before it is shared."""
    shift = np.uint64(BITS - 1 - bit)
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        one = ((fp[np.minimum(middle, len(fp) - 1)] >> shift) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, middle, high)
        low = np.where(open_ & ~one, middle + 1, low)
    return low


class Forest:
    """Union-find over positions; tells which pairs join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def joining(self, x: np.ndarray, y: np.ndarray) -> Iterator[int]:
        """Indexes of the pairs that join two trees, in order."""
        step = 10_000
        for at in range(0, len(x), step):
            # Most pairs of a large group are in one tree already; those are left out together.
            xs, ys = x[at : at + step], y[at : at + step]
            ends, place = np.unique(np.concatenate([xs, ys]), return_inverse=True)
            roots = np.array([self.root(e) for e in ends.tolist()])[place]
            for k in np.flatnonzero(roots[: len(xs)] != roots[len(xs) :]).tolist():
                if self.join(int(xs[k]), int(ys[k])):
                    yield at + k

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


LINKS = "u long, v long"
#: fp: 64 bits of the fingerprint, the agreeing block first; parts: all of it; vertex: its number.
MEMBER = ("crowd", "side", "differ", "fp", "vertex", "parts")
MEMBERS = "crowd long, side int, differ int, fp long, vertex long, parts binary"


def _links_of(first: int, reach: int, limit: int):
    """Task body: rows of whole crowds to the links of spanning forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_crowds(batches):
            crowd, side, differ, fp, vertex = (batch.column(c).to_numpy() for c in MEMBER[:-1])
            parts = _parts(batch)
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, side, crowd))
            crowd, side, differ, fp, vertex, parts = (x[order] for x in (crowd, side, differ, fp, vertex, parts))
            # Links matter only between fingerprints; one may stand in several crowds.
            _, place = np.unique(vertex, return_inverse=True)
            forest = Forest(len(fp))
            for i, j in walk(fp, crowd, side, differ, first, reach):
                near = np.bitwise_count(parts[i] ^ parts[j]).sum(axis=1, dtype=np.int64) <= limit
                i, j = i[near], j[near]
                kept = list(forest.joining(place[i], place[j]))
                if kept:
                    u, v = vertex[i[kept]], vertex[j[kept]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"]
                    )

    return run


def _parts(batch: pa.RecordBatch) -> np.ndarray:
    """The fingerprints of a batch as 64-bit numbers, a column per part."""
    raw = b"".join([p.as_buffer().to_pybytes() for p in batch.column("parts")])
    return np.frombuffer(raw, np.uint64).reshape(batch.num_rows, -1)


def _whole_crowds(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches sorted by crowd, cut and gathered so that no crowd is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        crowd = batch.column("crowd").to_numpy()
        last = int(np.searchsorted(crowd, crowd[-1], side="left"))
        # Everything before the last crowd of this batch is complete.
        ready = sum(b.num_rows for b in held) + last >= rows
        if ready and (last or (held and held[-1].column("crowd")[-1].as_py() != crowd[-1])):
            held.append(batch.slice(0, last))
            yield _joined(held)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def links(distinct: DataFrame, limit: int = 3, reach: int | None = None, blocks: int | None = None) -> DataFrame:
    """(u, v) with v < u: links that connect the rows (vertex, parts; distinct) within ``limit`` bits.

    Every 64-bit part is cut into ``blocks``; a pair is reached if a block agrees and its part differs
    in ``reach`` bits at most. With one part, ``limit`` + 1 blocks and ``reach`` = ``limit`` (as by
    default) that is every pair within the limit.
    """
    reach, blocks = limit if reach is None else reach, limit + 1 if blocks is None else blocks
    if BITS % blocks:
        raise ValueError("blocks must divide 64")
    width = BITS // blocks

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _parts(batch)
            for part in range(parts.shape[1]):
                for block in range(blocks):
                    front = turned(np.ascontiguousarray(parts[:, part]), block, width)
                    root = (front >> np.uint64(BITS - width)) | np.uint64((part * blocks + block) << width)
                    none = pa.array(np.zeros(len(front), np.int32))
                    columns = [pa.array(root.view(np.int64)), none, none, pa.array(front.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, batch.column("vertex"), batch.column("parts")], names=list(MEMBER)
                    )

    members = distinct.select("vertex", "parts").mapInArrow(turns, MEMBERS)
    found, first = None, width
    while True:
        sizes = members.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"))
        crowded, seen = materialize_with(
            sizes.where(F.col("n") > CROWD).select("crowd", F.lit(True).alias("crowded")), "simhash-crowds",
            {"n": F.count(F.lit(1))},
        )
        small, members = members, None
        if seen.get("n") and first + LEVELS <= BITS:
            told = small.join(crowded, "crowd", "left")
            small = told.where(F.col("crowded").isNull()).drop("crowded")
            members = told.where(F.col("crowded")).drop("crowded")
        dealt = small.repartition("crowd").sortWithinPartitions("crowd")
        part = materialize(dealt.mapInArrow(_links_of(first, reach, limit), LINKS), "simhash-links")
        found = part if found is None else found.union(part)
        if members is None:
            return found
        members = materialize(_deeper(members, first, reach), "simhash-deeper")
        first += LEVELS


#: Trie levels that Spark walks at once where a crowd is too large.
LEVELS = 6


def _deeper(members: DataFrame, first: int, distance: int) -> DataFrame:
    """Crowds divided by their node pairs ``LEVELS`` bits further down; the bits in which a pair differs add up.

    A crowd has at most 2 to the LEVELS nodes on a side, so a member is repeated for a bounded
    number of pairs: those of its node whose difference stays within ``distance``.
    """
    node = F.expr(f"shiftrightunsigned(shiftleft(fp, {first}), {BITS - LEVELS})").cast("int")
    members = members.withColumn("node", node)
    nodes = members.select("crowd", F.col("side").alias("other_side"), F.col("node").alias("other")).distinct()
    two_sided = members.groupBy("crowd").agg((F.max("side") != F.min("side")).alias("two_sided"))
    pairs = members.join(two_sided, "crowd").join(nodes, "crowd")
    pairs = pairs.where(F.col("two_sided") == (F.col("side") != F.col("other_side")))
    bits = F.col("differ") + F.bit_count(F.col("node").bitwiseXOR(F.col("other")))
    # In a two-sided crowd the pair is named by its sides, else by order.
    swapped = F.when(F.col("two_sided"), F.col("side") == 1).otherwise(F.col("node") > F.col("other"))
    low, high = F.when(swapped, F.col("other")).otherwise(F.col("node")), F.when(swapped, F.col("node")).otherwise(F.col("other"))
    return pairs.where(bits <= distance).select(
        F.xxhash64("crowd", low, high).alias("crowd"), swapped.cast("int").alias("side"),
        bits.cast("int").alias("differ"), "fp", "vertex", "parts",
    )


def grouped(marked: DataFrame, limit: int = 3, reach: int | None = None, blocks: int | None = None) -> DataFrame:
    """(parts, smallest): the smallest doc_id of the group of every distinct fingerprint of ``marked``.

    With one part its 64 bits are the vertex; wider fingerprints are numbered by a 64-bit hash.
    """
    distinct = marked.groupBy("parts").agg(F.min("doc_id").alias("least"), F.xxhash64("parts").alias("vertex"))
    distinct = materialize(distinct, "simhash-distinct")
    groups = connected_components(links(distinct, limit, reach, blocks))
    # A lone fingerprint is its own group.
    placed = distinct.join(groups, "vertex", "left").withColumn("group", F.coalesce("component_id", "vertex"))
    smallest = placed.groupBy("group").agg(F.min("least").alias("smallest"))
    return placed.join(smallest, "group").select("parts", "smallest")


def components(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    marked = materialize(fingerprints(docs, size), "simhash-fingerprints")
    named = grouped(marked, distance).withColumnRenamed("smallest", "component_id")
    # The bytes are little-endian; the first hex digits belong to the last byte.
    digits = F.lower(F.hex("parts"))
    number = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(BITS // 8 - 1, -1, -1)])
    return marked.join(named, "parts").select("doc_id", number.alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, component_id) of every row: texts whose 5-word shingles overlap by 0.8 or more."""
    marked = materialize(fingerprints(docs, size, wide_fingerprint), "simhash-fingerprints")
    named = grouped(marked, WIDE_LIMIT, WIDE_REACH, blocks=4)
    return marked.join(named, "parts").select("doc_id", F.col("smallest").alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` without near-copies: of each group one row with the smallest doc_id stays.

    Rows without an id stay. Of rows that repeat one id all stay or go together.
    """
    groups = near_copies(docs.where(F.col("doc_id").isNotNull()))
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
