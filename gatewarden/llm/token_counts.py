"""Token counts of whole texts, by the tokenizer's own library, in Arrow functions that return lengths only.

Texts of up to ``LONG`` bytes are counted where they are read, in batches of about ``BATCH`` bytes
each, so that a batch costs the same whether its texts are short or long. Longer texts are cut at
safe boundaries, their pieces dealt over all tasks by an exchange, counted in the same batches and
summed per text: one text of any length neither holds up a task nor fills a worker.

A boundary is safe when the tokens of both sides, counted apart, add up to those of the whole. For
tokenizers that drop white space and split words at it (``DROPPED``) that is the place before an ASCII
white space character: no special token holds one, normalisation never joins it with what comes
before, and no word crosses it. So a batch is cut at all of them, each of its distinct pieces is encoded
once, and a worker remembers the counts of some hundred thousand pieces. Scripts without spaces may also be cut behind a full-width stop that a
letter follows. For other tokenizers (``KEPT``: white space belongs to the next word's token) texts are
never cut.

Defined results
    null or empty text     0 bytes, 0 tokens (unless the tokenizer has tokens for an empty text)
    null doc_id            kept like any other row
    repeated rows          each is counted, and returned, once per row
    a long text without a safe boundary   one piece, however long
    special strings in a text             as the library does by default
    extra columns          dropped; the result has doc_id, n_bytes, n_tokens, over_limit
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Bytes of text that are encoded at once.
BATCH = 1 << 20
#: Texts above this many bytes are cut into pieces of about as many.
LONG = 1 << 20
#: Pieces whose counts a worker remembers.
REMEMBERED = 300_000
#: A tokenizer for which cuts are safe, and one for which they are not.
DROPPED, KEPT = "dropped", "kept"

_SPACE = regex.compile(r"[ \t\n\r]")
_STOP = regex.compile(r"[。，、！？；：](?=\p{L})")

#: Counters of this Python worker, by the tokenizer file's content.
_COUNTERS: dict[tuple, Callable[[list[bytes]], list[int]]] = {}


def counter(content: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """Token counts of a list of texts, by a tokenizer file's content; ``kind`` is its ending, json or model."""
    if kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    if kind != "json":
        raise ValueError(f"no library for a tokenizer file that ends in .{kind}")
    # The library's own threads would compete with Spark's tasks.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: list(map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False)))


class Pieces:
    """Counts of texts as sums over their pieces between ASCII white space; each distinct piece is encoded once."""

    def __init__(self, count: Callable[[list[str]], list[int]]):
        self.count = count
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[bytes]) -> list[int]:
        split = [text.split() for text in texts]
        wanted = set().union(*split)
        missing = list(wanted.difference(self.known))
        if len(self.known) + len(missing) > REMEMBERED:
            self.known = {piece: n for piece, n in self.known.items() if piece in wanted}
        for part in _by_bytes(np.array([len(p) for p in missing], np.int64), BATCH):
            self.known.update(zip(missing[part], self.count([p.decode() for p in missing[part]]), strict=True))
        return [sum(map(self.known.__getitem__, pieces)) for pieces in split]


def cut(text: str, most: int) -> Iterator[str]:
    """Pieces of about ``most`` characters that end at safe boundaries; together they are the text."""
    start, n = 0, len(text)
    while n - start > most:
        space = _SPACE.search(text, start + most)
        end = space.start() if space else n
        # A nearer stop is only looked for where white space is far away.
        if end - start > 2 * most and (stop := _STOP.search(text, start + most, end)):
            end = stop.end()
        yield text[start:end]
        start = end
    yield text[start:]


def _by_bytes(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows with about ``most`` bytes each; a larger row is a slice of its own."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield slice(at, end)
        at = end


def _counting(content, kind: str, boundaries: str):
    """Arrow function: the batch's columns but its text, and ``tokens``; ``content`` is the broadcast tokenizer file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hash(content.value), kind, boundaries)
        if key not in _COUNTERS:
            library = counter(content.value, kind)
            _COUNTERS[key] = Pieces(library) if boundaries == DROPPED else lambda texts: library([t.decode() for t in texts])
        count = _COUNTERS[key]
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes = np.array([len(t.as_buffer()) for t in texts], np.int64)
            tokens = np.zeros(len(sizes), np.int64)
            # In order of size, so that the texts of a batch are alike.
            order = np.argsort(sizes, kind="stable")
            for part in _by_bytes(sizes[order], BATCH):
                rows = order[part]
                tokens[rows] = count(texts.take(pa.array(rows)).to_pylist())
            others = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in others), pa.array(tokens)],
                names=[*(batch.schema.names[i] for i in others), "tokens"],
            )

    return run


def _cutting(most: int):
    """Arrow function: every row's text in pieces, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One row at a time: a long text's pieces are some megabytes together, a batch's may be gigabytes.
            for i in range(batch.num_rows):
                pieces = list(cut(batch.column("text")[i].as_py(), most))
                again = pa.array(np.full(len(pieces), i))
                others = [j for j, name in enumerate(batch.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).take(again) for j in others), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())],
                    names=[*(batch.schema.names[j] for j in others), "piece", "text"],
                )

    return run


def counts(docs: DataFrame, tokenizer: str, limit: int = 2048, boundaries: str = DROPPED, long: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``tokenizer`` is a file that the driver reads and broadcasts.

    ``long`` overrides ``LONG``. Results do not depend on it.
    """
    long = LONG if long is None else long
    kind = os.path.splitext(tokenizer)[1].lstrip(".")
    with open(tokenizer, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = rows if boundaries == KEPT else rows.where(F.col("n_bytes") <= long)
    counting = _counting(content, kind, boundaries)
    found = short.mapInArrow(counting, f"doc_id {id_type}, n_bytes long, tokens long")
    if boundaries != KEPT:
        found = found.unionByName(_long_counts(rows.where(F.col("n_bytes") > long), counting, long, id_type))
    return found.select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))


def _long_counts(rows: DataFrame, counting, long: int, id_type: str) -> DataFrame:
    """Counts of texts that are cut. A text is known by its id and two hashes, so that a repeated task gives
    the same keys; of repeated rows the sum is divided by how many they are, and returned as often."""
    keyed = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})
    pieces = keyed.mapInArrow(_cutting(long), f"doc_id {id_type}, n_bytes long, a long, b long, piece int, text string")
    dealt = pieces.repartition(F.xxhash64("doc_id", "a", "piece"))
    counted = dealt.mapInArrow(counting, f"doc_id {id_type}, n_bytes long, a long, b long, piece int, tokens long")
    per_text = counted.groupBy("doc_id", "n_bytes", "a", "b").agg(
        F.sum("tokens").alias("tokens"), F.count_if(F.col("piece") == 0).alias("copies")
    )
    one = (F.col("tokens") / F.col("copies")).cast("long")
    return per_text.select("doc_id", "n_bytes", one.alias("tokens"), F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
