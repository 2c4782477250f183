"""Removal of passages that an earlier document holds, found through difference-cover anchors.

A window is ``LENGTH`` (13) consecutive words. The words covered by a window that also starts in
a document with a smaller doc_id go. Comparing all windows would move every word position, so
positions are sampled first: the residues {0, 1, 3} form a difference cover of the integers
modulo 7, so two equal windows, wherever they start in their documents, contain 7-word anchors
at the same offset whose positions in both documents have a residue in the cover. Only 3 of 7
positions are hashed and exchanged; an anchor found in two documents is then extended: the
13-word windows around it are hashed (64 and 16 further bits) and compared exactly that way.

Steps, each an exchange by bucket of the hash or by chunk (see ``chunks``):
anchors of every chunk -> anchors that two documents share -> windows around them ->
smallest doc_id of every window -> words removed. An entry travels once per chunk, not once per
document, so a passage in a third of all documents loads no task.

Defined results
    null or empty text     no words, nothing removed, the text stays as it is
    null doc_id            neither gives nor loses words
    repeated rows          rows of one doc_id never take words from each other
    fewer than 13 words    nothing removed
    extra columns          kept as they are; n_words and n_removed of the input are replaced
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gatewarden.llm import chunks as C

LENGTH = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = LENGTH - PERIOD + 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

PACKED = "bucket int, chunk int, packed array<binary>"


def _anchors(words: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions at the cover's residues that a 13-word text has room for, and their hashes."""
    fits = (words.room() >= ANCHOR) & np.isin(words.place() % PERIOD, COVER)
    fits &= np.repeat(words.has_id & (words.count >= LENGTH), words.count)
    at = np.flatnonzero(fits)
    return at, C.sequence_hash(words.hash, at, ANCHOR, seed=1)


def _windows(words: C.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and check bits of the windows that start at ``at``."""
    check = C.sequence_hash(words.hash, at, LENGTH, seed=3) & np.uint64(0xFFFF)
    return C.sequence_hash(words.hash, at, LENGTH, seed=2), check


def _spans(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _parcels(n: int, chunk: int, keys: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """Sorted keys and their columns cut into one row per bucket."""
    cuts = np.r_[0, np.searchsorted(keys, C.bucket_cuts(n)), len(keys)]
    buckets = np.flatnonzero(np.diff(cuts))
    rows = []
    for b in buckets:
        part = slice(cuts[b], cuts[b + 1])
        rows.append([C.pack_sorted(keys[part]), *[C.pack_planes(c[part]) for c in columns]])
    return pa.table(
        {
            "bucket": pa.array(buckets, pa.int32()),
            "chunk": pa.array(np.full(len(buckets), chunk), pa.int32()),
            "packed": pa.array(rows, pa.list_(pa.binary())),
        }
    )


def _received(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Chunk of every entry of a bucket, and the entry's key and columns."""
    chunk, parts = [], []
    for at, packed in zip(table.column("chunk").to_pylist(), table.column("packed").to_pylist(), strict=True):
        columns = [C.unpack_sorted(packed[0]), *map(C.unpack_planes, packed[1:])]
        chunk.append(np.full(len(columns[0]), at, np.int32))
        parts.append(columns)
    return np.concatenate(chunk), [np.concatenate(c) for c in zip(*parts, strict=True)]


def _answers(bucket: int, chunk: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """Entries of a bucket, sorted by chunk and key, as one row per chunk."""
    starts = _spans(chunk)
    ends = np.r_[starts[1:], len(chunk)][: len(starts)]
    rows = [
        [C.pack_sorted(columns[0][a:b]), *[C.pack_planes(c[a:b]) for c in columns[1:]]]
        for a, b in zip(starts, ends, strict=True)
    ]
    return pa.table(
        {
            "bucket": pa.array(np.full(len(starts), bucket), pa.int32()),
            "chunk": pa.array(chunk[starts], pa.int32()),
            "packed": pa.array(rows, pa.list_(pa.binary())),
        }
    )


def _ordered_ids(doc_id: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned numbers in the same order."""
    return doc_id.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _signed_ids(ordered: np.ndarray) -> np.ndarray:
    return (ordered ^ np.uint64(1 << 63)).view(np.int64)


def removal_marks(words: C.Words, keys: np.ndarray, checks: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """For every word whether it goes; shared windows (sorted by hash) come with their first document."""
    gone = np.zeros(len(words.hash) + 1, np.int64)
    if len(keys):
        at = np.flatnonzero((words.room() >= LENGTH) & np.repeat(words.has_id, words.count))
        hashes, check = _windows(words, at)
        found = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = (keys[found] == hashes) & (checks[found] == check)
        hit &= smallest[found] < np.repeat(words.doc_id, words.count)[at]
        at = at[hit]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + LENGTH, -1)
    return np.cumsum(gone[:-1]) > 0


def without_words(raw: bytes, gone: np.ndarray) -> bytes:
    """A text without the marked words; a kept word keeps the separator in front of it."""
    kept, last_end, out = False, 0, []
    for match, drop in zip(_WORD.finditer(raw), gone, strict=True):
        if not drop:
            if kept:
                out.append(raw[last_end : match.start()])
            out.append(match.group())
            kept = True
        last_end = match.end()
    return b"".join(out)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and n_words, n_removed (long)."""
    docs = docs.drop("n_words", "n_removed")
    n = C.chunk_count(docs)
    buckets = min(n, C.MOST_BUCKETS)
    dealt = C.chunked(docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}), n)

    def anchors_of(key, table):
        words = C.Words(C.rows_of(table.column("docs")))
        at, found = _anchors(words)
        order = np.argsort(found, kind="stable")
        found, ids = found[order], np.repeat(words.doc_id, words.count)[at][order]
        starts = _spans(found)
        several = _several(ids, starts)
        return _parcels(buckets, key[0].as_py(), found[starts], [several.astype(np.uint64)])

    def shared_anchors(key, table):
        chunk, (found, several) = _received(table)
        order = np.lexsort((chunk, found))
        chunk, found, several = chunk[order], found[order], several[order]
        starts = _spans(found)
        sizes = np.diff(np.r_[starts, len(found)])
        shared = np.repeat((sizes > 1) | (several[starts] > 0), sizes) if len(starts) else np.empty(0, bool)
        chunk, found = chunk[shared], found[shared]
        order = np.lexsort((found, chunk))
        return _answers(key[0].as_py(), chunk[order], [found[order]])

    def windows_of(key, table, answers):
        chunk = key[0].as_py()
        shared = _keys(answers)
        if not len(shared) or not table.num_rows:
            return _parcels(buckets, chunk, np.empty(0, np.uint64), [np.empty(0, np.uint64)] * 3)
        words = C.Words(C.rows_of(table.column("docs")))
        at, found = _anchors(words)
        place = np.minimum(np.searchsorted(shared, found), len(shared) - 1)
        at = at[shared[place] == found]
        # An anchor lies in the windows that start up to PERIOD - 1 words before it.
        near = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(near, np.maximum(at - (PERIOD - 1), 0), 1)
        np.add.at(near, at + 1, -1)
        owners = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (words.room() >= LENGTH))
        ids = np.repeat(words.doc_id, words.count)[owners]
        hashes, check = _windows(words, owners)
        order = np.lexsort((ids, check, hashes))
        hashes, check, ids = hashes[order], check[order], ids[order]
        starts = _spans(hashes, check)
        several = _several(ids, starts)
        return _parcels(
            buckets, chunk, hashes[starts], [check[starts], _ordered_ids(ids[starts]), several.astype(np.uint64)]
        )

    def first_documents(key, table):
        chunk, (found, check, ids, several) = _received(table)
        order = np.lexsort((ids, check, found))
        chunk, found, check, ids, several = (c[order] for c in (chunk, found, check, ids, several))
        starts = _spans(found, check)
        smallest = np.repeat(ids[starts], np.diff(np.r_[starts, len(found)]))
        # A chunk needs the answer if one of its documents comes after the smallest.
        asks = (ids > smallest) | (several > 0)
        chunk, found, check, smallest = chunk[asks], found[asks], check[asks], smallest[asks]
        order = np.lexsort((check, found, chunk))
        return _answers(key[0].as_py(), chunk[order], [found[order], check[order], smallest[order]])

    result = T.StructType([*docs_schema(docs).fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(key, table, answers):
        if not table.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(result.fields, _arrow_types(result), strict=True)})
        rows = C.rows_of(table.column("docs"))
        words = C.Words(rows)
        gone = removal_marks(words, *_first_keys(answers))
        removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), words.start) if len(words.count) else words.count
        removed = np.where(words.count > 0, removed, 0)
        texts = rows.column("text").cast(pa.binary()).to_pylist()
        for i in np.flatnonzero(removed):
            texts[i] = without_words(texts[i], gone[words.start[i] : words.end[i]])
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))
        return rows.append_column("n_words", pa.array(words.count)).append_column("n_removed", pa.array(removed))

    by_chunk = dealt.groupBy("chunk")
    anchors = by_chunk.applyInArrow(anchors_of, PACKED)
    shared = anchors.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared_anchors, PACKED)
    windows = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(windows_of, PACKED)
    first = windows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(first_documents, PACKED)
    return by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(cut, result)


def docs_schema(docs: DataFrame) -> T.StructType:
    """The schema of the packed rows: ids as long, texts as string, everything nullable."""
    kinds = {"doc_id": T.LongType(), "text": T.StringType()}
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType), True) for f in docs.schema.fields])


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema, timezone="UTC").types)


def _several(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every run whether it holds more than one id."""
    if not len(starts):
        return np.empty(0, bool)
    return np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)


def _keys(answers: pa.Table) -> np.ndarray:
    """Sorted hashes from the answers of all buckets to a chunk."""
    parts = [C.unpack_sorted(p[0]) for p in answers.column("packed").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _first_keys(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (sorted), check bits and smallest doc_id of the windows a chunk was answered."""
    parts = answers.column("packed").to_pylist()
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = np.concatenate([C.unpack_sorted(p[0]) for p in parts])
    check, smallest = (np.concatenate([C.unpack_planes(p[i]) for p in parts]) for i in (1, 2))
    order = np.argsort(keys, kind="stable")
    return keys[order], check[order], _signed_ids(smallest)[order]


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    words = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
