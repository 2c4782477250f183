"""Documents dealt into chunks of bounded size, and hash tables exchanged between chunks and buckets.

Operators that compare passages of all documents would need a row per word position. Here a
chunk (some megabytes of whole documents) first reduces its positions to distinct 64-bit
hashes; sorted runs of them travel to the bucket that owns their range, one packed row per
chunk and bucket. What a hot passage costs is one entry per chunk, however many documents
carry it. Answers travel back to chunks the same way. All exchanges are Spark's, keyed by
``chunk`` or ``bucket``, so a lost executor only repeats its own part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gatewarden.plans.joins import estimated_bytes

#: Stored bytes of documents per chunk; texts take two to three times as much in memory.
CHUNK_BYTES = 8 << 20
#: More buckets than this would leave a chunk only a few hashes for each.
MOST_BUCKETS = 1 << 16
CHUNK_SCHEMA = "chunk int, docs binary"


def chunk_count(docs: DataFrame) -> int:
    """Chunks for ``docs``: as many as its files need, at least the shuffle partitions.

    The number only shapes the work; results do not depend on it.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(docs)
    return max(least, math.ceil(size / CHUNK_BYTES)) if size < 2**60 else least


def chunked(docs: DataFrame, n: int) -> DataFrame:
    """(chunk, docs): whole rows as compressed Arrow batches, exchanged by chunk.

    A row's chunk depends on its id and text only, so it is the same on every run.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    rows = docs.select(place.alias("chunk"), F.struct("*").alias("row"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        for batch in batches:
            at = batch.column("chunk").to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            found, starts = np.unique(at[order], return_index=True)
            row = batch.column("row")
            blobs = []
            for part in np.split(order, starts[1:]):
                one = pa.RecordBatch.from_struct_array(row.take(pa.array(part)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, one.schema, options=options) as writer:
                    writer.write_batch(one)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "docs"]
            )

    return rows.mapInArrow(pack, CHUNK_SCHEMA).repartition(n, "chunk")


def rows_of(blobs: pa.ChunkedArray) -> pa.Table:
    """The documents of packed batches."""
    tables = [pa.ipc.open_stream(b.as_buffer()).read_all() for part in blobs.chunks for b in part]
    return pa.concat_tables(tables)


class Words:
    """Hashes of all words of some texts, one after the other, and where each text's words are."""

    def __init__(self, table: pa.Table, lower: bool = False):
        ids = table.column("doc_id").cast(pa.int64())
        self.has_id = np.asarray(ids.is_valid())
        self.doc_id = np.asarray(ids.fill_null(0))
        hashes, counts = [], []
        for text in table.column("text").cast(pa.binary()):
            raw = text.as_py() or b""
            # Bytes are split at (and lowered as) ASCII characters only.
            words = (raw.lower() if lower else raw).split()
            counts.append(len(words))
            hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        self.count = np.array(counts, np.int64)
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)

    def owner(self) -> np.ndarray:
        """For every word the index of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def place(self) -> np.ndarray:
        """For every word its position in its text."""
        return np.arange(len(self.hash)) - np.repeat(self.start, self.count)

    def room(self) -> np.ndarray:
        """For every word how many words its text has from there on."""
        return np.repeat(self.end, self.count) - np.arange(len(self.hash))


def sequence_hash(words: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit hashes of the ``length`` words from each position of ``at``."""
    found = np.full(len(at), seed * 2 + 1, np.uint64)
    for step in range(length):
        found ^= words[at + step]
        found *= np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    return found


def bucket_cuts(n: int) -> np.ndarray:
    """Lower ends of the hash ranges of buckets 1..n-1."""
    return np.array([(i << 64) // n for i in range(1, n)], np.uint64)


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as planes of difference bytes: the high planes are nearly empty."""
    return pack_planes(np.diff(hashes, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(packed), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values byte plane by byte plane, empty high planes left out."""
    values = np.ascontiguousarray(values, "<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width]
    return len(values).to_bytes(8, "little") + planes.T.tobytes()


def unpack_planes(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.zeros((n, 8), np.uint8)
    if n:
        body = np.frombuffer(packed, np.uint8, offset=8).reshape(-1, n)
        planes[:, : len(body)] = body.T
    return planes.reshape(-1).view("<u8")
