"""Stupid-backoff scores of every document against the rest of the corpus, as joins of n-gram tables.

Tables, all exchanged by Spark (see ``chunks`` for the packed rows):
    grams(chunk, order, gram, n)   distinct n-grams of a chunk, by hash range of the gram
    counts(order, gram, n)         their sums over all documents
    grams join counts              answered to the chunk, in the order of its own grams
A chunk then looks up every position of its documents, some hundred thousand words at a time, and sums per
document. What a worker holds beside the chunk's texts are its distinct grams and their counts; buckets are
joined in slices of their hash range.

A document does not vouch for itself: its own occurrences are taken off every count. With c the
count in all other documents, the score of word i after its (up to) ``order`` - 1 predecessors is
c(gram) / c(context) for the longest gram with c > 0, times ``backoff`` for every order given up;
a word found nowhere else gets one more ``backoff`` over the number of words elsewhere.
Words are lower-cased in A-Z and split at white space; counts cover whole texts of all documents.

Defined results
    null or empty text     n_words 0, log_score 0, mean_log_score null
    null doc_id            scored, counted as a document of its own
    repeated rows          each row is a document: copies vouch for one another
    a corpus of one        every word takes the last step, over a count of one
    extra columns          ignored
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewarden.llm import chunks as C

#: Words that are scored at once; a longer text is a portion of its own.
PORTION = 200_000
#: Slices of a bucket's hash range that are joined one after the other.
SLICES = 8

PARCELS = "bucket int, chunk int, gram_order int, packed array<binary>"
SCORES = "doc_id long, n_words long, n_full long, n_unseen long, log_score double"


def _keys(hashes: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the grams of ``order`` words that end at ``ends``."""
    if order == 0:
        return np.zeros(len(ends), np.uint64)
    return C.sequence_hash(hashes, ends - (order - 1), order, seed=10 + order)


def _distinct(words: C.Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct grams of a chunk and how often each occurs (order 0: the number of words)."""
    if order == 0:
        return np.zeros(1, np.uint64), np.array([len(words.hash)])
    return np.unique(_keys(words.hash, np.flatnonzero(words.place() >= order - 1), order), return_counts=True)


def _portions(counts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about ``PORTION`` words each."""
    ends, at, found = np.cumsum(counts), 0, []
    while at < len(counts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PORTION, side="right")))
        found.append((at, end))
        at = end
    return found


def _rows(bucket, chunk, order, packed) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int32()),
            "chunk": pa.array(chunk, pa.int32()),
            "gram_order": pa.array(order, pa.int32()),
            "packed": pa.array(packed, pa.list_(pa.binary())),
        }
    )


def scores(docs: DataFrame, order: int = 3, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_words, n_full (words scored at the full order), n_unseen, log_score, mean_log_score of every row."""
    n = C.chunk_count(docs)
    buckets = min(n, C.MOST_BUCKETS)
    dealt = C.chunked(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), n)

    def grams_of(key, table):
        words = C.Words(C.rows_of(table.column("docs")), lower=True)
        bucket, orders, packed = [], [], []
        for k in range(order + 1):
            grams, counts = _distinct(words, k)
            cuts = np.r_[0, np.searchsorted(grams, C.bucket_cuts(buckets)), len(grams)]
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                bucket.append(b)
                orders.append(k)
                packed.append([C.pack_sorted(grams[part]), C.pack_planes(counts[part].astype(np.uint64))])
            del grams, counts
        return _rows(bucket, [key[0].as_py()] * len(bucket), orders, packed)

    def joined_counts(key, table):
        chunk = table.column("chunk").to_numpy()
        orders = table.column("gram_order").to_numpy()
        packed = table.column("packed")
        answers: tuple[list, list, list] = ([], [], [])
        for k in np.unique(orders):
            rows = np.flatnonzero(orders == k)
            parts = [packed[int(r)].as_py() for r in rows]
            grams = [C.unpack_sorted(p[0]) for p in parts]
            # Counts are replaced by their sums in place, slice by slice.
            told = [C.unpack_planes(p[1]) for p in parts]
            del parts
            low, high = (int(f(g[i] for g in grams)) for f, i in ((min, 0), (max, -1)))
            bounds = np.array([low + (high - low) * s // SLICES for s in range(1, SLICES)], np.uint64)
            cuts = [np.r_[0, np.searchsorted(g, bounds), len(g)] for g in grams]
            for s in range(SLICES):
                spots = [slice(c[s], c[s + 1]) for c in cuts]
                joined = np.concatenate([g[at] for g, at in zip(grams, spots, strict=True)])
                if not len(joined):
                    continue
                _, which = np.unique(joined, return_inverse=True)
                total = np.zeros(which.max() + 1, np.uint64)
                np.add.at(total, which, np.concatenate([n[at] for n, at in zip(told, spots, strict=True)]))
                sums, first = total[which], 0
                for n, at in zip(told, spots, strict=True):
                    n[at] = sums[first : first + at.stop - at.start]
                    first += at.stop - at.start
            answers[0].extend(chunk[rows].tolist())
            answers[1].extend([int(k)] * len(rows))
            answers[2].extend([C.pack_planes(n)] for n in told)
        return _rows([key[0].as_py()] * len(answers[0]), *answers)

    def score(key, table, answers):
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _SCORES})
        words = C.Words(C.rows_of(table.column("docs")), lower=True)
        order_of, packed = answers.column("gram_order").to_numpy(), answers.column("packed")
        by_bucket = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        known = []
        for k in range(order + 1):
            grams = _distinct(words, k)[0]
            parts = [C.unpack_planes(packed[int(r)].as_py()[0]) for r in by_bucket if order_of[r] == k]
            everywhere = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            if len(everywhere) != len(grams):
                raise RuntimeError(f"chunk {key[0]}: {len(grams)} grams of order {k}, {len(everywhere)} counts")
            known.append((grams, everywhere))
        found = [_scored(words, first, last, known, backoff) for first, last in _portions(words.count)]
        n_full, n_unseen, log_score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        table_of = {
            "doc_id": pa.array(words.doc_id, mask=~words.has_id),
            "n_words": pa.array(words.count),
            "n_full": pa.array(n_full, pa.int64()),
            "n_unseen": pa.array(n_unseen, pa.int64()),
            "log_score": pa.array(log_score, pa.float64()),
        }
        return pa.table(table_of)

    by_chunk = dealt.groupBy("chunk")
    grams = by_chunk.applyInArrow(grams_of, PARCELS)
    counts = grams.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(joined_counts, PARCELS)
    found = by_chunk.cogroup(counts.groupBy("chunk")).applyInArrow(score, SCORES)
    return found.withColumn("mean_log_score", F.try_divide("log_score", "n_words"))


_SCORES = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_full", pa.int64()), ("n_unseen", pa.int64()), ("log_score", pa.float64())]
)


def _scored(words: C.Words, first: int, last: int, known: list, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_full, n_unseen and log_score of the texts ``first`` to ``last`` (excluded) of a chunk."""
    order, counts = len(known) - 1, words.count[first:last]
    begin = int(words.start[first])
    hashes = words.hash[begin : int(words.end[last - 1])]
    size = len(hashes)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(size) - np.repeat(words.start[first:last] - begin, counts)
    best, value = np.zeros(size, np.int64), np.zeros(size)
    # Counts elsewhere of the gram of the order below that ends at each word (order 0: all words).
    below = np.zeros(size)
    for k, (grams, everywhere) in enumerate(known):
        ends = np.flatnonzero(place >= k - 1)
        distinct, which = np.unique(_keys(hashes, ends, k), return_inverse=True)
        totals = everywhere[np.searchsorted(grams, distinct)].astype(np.int64) if len(distinct) else np.empty(0, np.int64)
        _, pair, own = np.unique(owner[ends] * np.int64(len(distinct) + 1) + which, return_inverse=True, return_counts=True)
        here = np.zeros(size)
        if len(ends):
            here[ends] = totals[which] - own[pair]
        if k == 0:
            value = -np.log(np.maximum(here, 1.0))
        else:
            # The context of the gram that ends at a word ends at the word before.
            context = below if k == 1 else np.r_[0.0, below[:-1]]
            seen = here > 0
            best[seen] = k
            value[seen] = np.log(here[seen] / context[seen])
        below = here
    value += np.log(backoff) * (np.minimum(place + 1, order) - best)
    starts = words.start[first:last] - begin
    return _sums((best == order).astype(np.int64), counts, starts), _sums((best == 0).astype(np.int64), counts, starts), _sums(value, counts, starts)


def _sums(values: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of word values per text; texts without words get 0."""
    if not len(counts):
        return values[:0]
    found = np.add.reduceat(np.r_[values, np.zeros(1, values.dtype)], starts)
    return np.where(counts > 0, found, np.zeros(1, values.dtype))
