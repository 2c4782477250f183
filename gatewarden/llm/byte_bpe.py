"""Byte-level BPE encoding and decoding; the merges run as recursive DuckDB queries per partition.

A text is split by the tokenizer's pattern. Distinct pieces that are no token themselves become
rows (piece, position, token, next position, next token), one per byte; a recursive query joins
them with the merge table and contracts each piece's leftmost pair of minimum rank until no pair
is left. An ordered aggregation of the last rows gives the ids, and, joined with the vocabulary,
the decoded bytes. Pieces repeat, so each Python worker keeps a bounded memory of results.

The rows of a recursion grow with the square of a piece, so pieces go in portions of bounded
total, and pieces over ``LONG`` bytes are contracted by the same rule with a heap instead.

Defined results
    null or empty text     no ids, decoded to no bytes
    null doc_id, repeated rows, extra columns   kept as they are (columns named ids and decoded are replaced)
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

LONG = 64
#: Rows that one recursive query may make (sum of squared piece lengths).
PORTION = 1_000_000
#: Bytes of text that are encoded and decoded at once.
TEXTS = 1 << 20
#: Pieces that a worker remembers, and as many again of those before.
REMEMBERED = 300_000
DUCKDB_MEMORY = "100MB"

_MERGE = """
WITH RECURSIVE steps AS (
  SELECT w, p, tok, np, nxt, false AS finished FROM (
    SELECT w, p, tok, lead(p) OVER line AS np, lead(tok) OVER line AS nxt FROM start
    WINDOW line AS (PARTITION BY w ORDER BY p))
  UNION ALL
  (WITH best AS (
     -- the smallest rank, and of equal ranks the leftmost position
     SELECT s.w, min((m.rank::BIGINT << 32) | s.p) AS key, arg_min(s.np, (m.rank::BIGINT << 32) | s.p) AS gone
     FROM steps s JOIN merges m ON m.l = s.tok AND m.r = s.nxt WHERE NOT s.finished GROUP BY s.w),
   pair AS (
     SELECT b.w, b.key & 4294967295 AS here, (b.key >> 32)::INT AS tok, b.gone, d.np, d.nxt
     FROM best b JOIN steps d ON d.w = b.w AND d.p = b.gone)
   SELECT s.w, s.p,
     CASE WHEN s.p = e.here THEN e.tok ELSE s.tok END,
     CASE WHEN s.p = e.here THEN e.np ELSE s.np END,
     CASE WHEN s.p = e.here THEN e.nxt WHEN s.np = e.here THEN e.tok ELSE s.nxt END,
     e.w IS NULL
   FROM steps s LEFT JOIN pair e ON e.w = s.w WHERE NOT s.finished AND (e.w IS NULL OR s.p <> e.gone)))
SELECT w, tok FROM steps WHERE finished ORDER BY w, p
"""

# One thread and an ordered input: the texts' rows reach the aggregate in their order.
_DECODE = """
SELECT t, string_agg(chars, '') AS chars
FROM (SELECT t, chars FROM given JOIN vocabulary USING (tok) ORDER BY t, pos) GROUP BY t
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and a number per line)."""
    with open(path, "rb") as lines:
        return parse_ranks(lines.read())


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for bytes {missing[:5]}")
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Ids (32-bit little-endian) of pieces; what is not met again is forgotten.
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        merges = [
            (ranks[whole[:i]], ranks[whole[i:]], rank)
            for whole, rank in ranks.items()
            for i in range(1, len(whole))
            if whole[:i] in ranks and whole[i:] in ranks
        ]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
        kind = pa.int32()
        left, right, rank = zip(*merges, strict=True) if merges else ((), (), ())
        self._table("merges", {"l": pa.array(left, kind), "r": pa.array(right, kind), "rank": pa.array(rank, kind)})
        # A character per byte, since a token need not be UTF-8.
        chars = [token.decode("latin-1") for token in ranks]
        self._table("vocabulary", {"tok": pa.array(list(ranks.values()), kind), "chars": pa.array(chars)})

    def _table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.con.register("arriving", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM arriving")
        self.con.unregister("arriving")

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet."""
        portion, rows = [], 0
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.ids[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.ids[piece] = np.array(self.contracted(raw), "<i4").tobytes()
            else:
                portion.append((piece, raw))
                rows += len(raw) ** 2
                if rows > PORTION:
                    self._merge(portion)
                    portion, rows = [], 0
        if portion:
            self._merge(portion)

    def _merge(self, portion: list[tuple[str, bytes]]) -> None:
        sizes = np.array([len(raw) for _, raw in portion])
        ends = np.cumsum(sizes)
        start = {
            "w": pa.array(np.repeat(np.arange(len(portion), dtype=np.int32), sizes)),
            "p": pa.array((np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32)),
            "tok": pa.array(self.byte[np.frombuffer(b"".join(raw for _, raw in portion), np.uint8)]),
        }
        found = self._answer("start", start, _MERGE)
        w, flat = np.asarray(found["w"]), np.asarray(found["tok"], "<i4").tobytes()
        begins = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        ends = np.r_[begins[1:], len(w)]
        for piece, begin, end in zip(w[begins].tolist(), (begins * 4).tolist(), (ends * 4).tolist(), strict=True):
            self.ids[portion[piece][0]] = flat[begin:end]

    def _answer(self, name: str, columns: dict[str, pa.Array], sql: str) -> dict[str, pa.Array]:
        self.con.register(name, pa.table(columns))
        found = self.con.sql(sql).to_arrow_table().combine_chunks()
        self.con.unregister(name)
        return {c: found[c].chunk(0) if found.num_rows else pa.array([]) for c in found.schema.names}

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of every text's ids, by an ordered aggregation of their rows."""
        counts = [len(i) // 4 for i in ids]
        flat = np.frombuffer(b"".join(ids), "<i4")
        given = {
            "t": pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), counts)),
            "pos": pa.array(np.arange(len(flat), dtype=np.int32)),
            "tok": pa.array(flat),
        }
        decoded = [b""] * len(ids)
        if len(flat):
            found = self._answer("given", given, _DECODE)
            for t, chars in zip(found["t"].to_pylist(), found["chars"].to_pylist()):
                decoded[t] = chars.encode("latin-1")
        return decoded

    def contracted(self, raw: bytes) -> list[int]:
        """Ids of one long piece: leftmost pair of minimum rank first, kept in a heap."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n

        def rank(i: int) -> int | None:
            return ranks.get(raw[i : end[after[i]]]) if after[i] < n else None

        heap = [(r, i, end[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            # Entries of pairs that have changed since are stale.
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    def run(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids (32-bit little-endian) and decoded bytes of each text."""
        split = [self.split(text) if text else [] for text in texts]
        wanted = set().union(*split)
        if len(self.ids) + len(wanted) > REMEMBERED:
            self.older, self.ids = self.ids, {}
        missing = wanted.difference(self.ids)
        met = missing.intersection(self.older)
        self.ids.update(zip(met, map(self.older.__getitem__, met)))
        self.learn(missing - met)
        ids = [b"".join(map(self.ids.__getitem__, pieces)) for pieces in split]
        decoded = self.decode(ids)
        for text, back in zip(texts, decoded, strict=True):
            if back != (text or "").encode():
                raise RuntimeError("the decoded bytes differ from the text that was encoded")
        return ids, decoded


_CODECS: dict[tuple, Codec] = {}


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of each whole ``text`` and ``decoded`` (binary), the bytes of those ids.

    The rank file (under a megabyte) is read once and broadcast.
    """
    docs = docs.drop("ids", "decoded")
    with open(ranks_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hash(content.value), pattern)
        codec = _CODECS.get(key)
        if codec is None:
            codec = _CODECS[key] = Codec(parse_ranks(content.value), pattern)
        for batch in batches:
            # Portions of a megabyte of text keep the lists of pieces small.
            for part in portions(batch):
                ids, decoded = codec.run(part.column("text").to_pylist())
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])]
                listed = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, listed, pa.array(decoded, pa.binary())], names=[*part.schema.names, "ids", "decoded"]
                )

    schema = T.StructType(
        [*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    )
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def portions(batch: pa.RecordBatch, most: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text is a slice of its own."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text").cast(pa.binary())])
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(sizes[at:])
        n = max(1, int(np.searchsorted(total, most, side="right")))
        yield batch.slice(at, n)
        at += n


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the decimal ids joined by one space and of the decoded bytes."""
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
