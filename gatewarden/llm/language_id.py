"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit tells from hashed byte n-grams of
the text whether the bit is set. Decoding takes the language whose codeword has the smallest
loss over all bits, each bit weighted by how well its classifier did on the training rows, so
single wrong bits are outvoted. The share of the winner among exp(-loss) of all languages is the
score; a text whose two best languages lie close together is flagged as ambiguous.

Training learns every language from a sample of its rows (``Training.rows_per_language``, smallest
hashes first; fewer where all languages together would exceed ``Training.most_rows``, one at
least). The n-grams of the sampled rows' whole texts are counted where they lie; the counts are
fitted in the driver. Prediction covers every whole text where it lies.

Defined results
    null text, no letter   language ``und``, score 0, not ambiguous
    one language learned   always that language, score 1
    no language learned    ``und`` for all
    null doc_id            predicted like any other
    repeated rows          each predicted alone; learned once
    extra columns          kept; lang_pred, score and ambiguous of the input are replaced
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gatewarden.plans.durable import materialize, materialize_with

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search
_SPACES = regex.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+").sub


@dataclass(frozen=True)
class Training:
    rows_per_language: int = 250
    #: Rows of all languages together; more languages have fewer rows each.
    most_rows: int = 16_000
    #: Bits of each n-gram's hash, so 2 to this power weights per classifier.
    hash_bits: int = 15
    passes: int = 30
    #: Winners below this share of exp(-loss) are ambiguous.
    ambiguous_below: float = 0.6


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: languages x bits, of -1 and 1
    codes: np.ndarray
    #: hashed n-grams x bits
    weights: np.ndarray
    bias: np.ndarray
    #: trust in each bit, 1 on average
    trust: np.ndarray
    ambiguous_below: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Share of exp(-loss) of each language for the margins of some texts."""
        # Logistic loss of every bit's margin against every codeword, weighted by the bit's trust.
        loss = (np.logaddexp(0.0, -features) * self.trust) @ (self.codes.T > 0)
        loss += (np.logaddexp(0.0, features) * self.trust) @ (self.codes.T < 0)
        loss -= loss.min(axis=1, keepdims=True)
        shares = np.exp(-loss)
        return shares / shares.sum(axis=1, keepdims=True)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1; rows of a Hadamard matrix, so any two differ in half of the bits.

    The constant first column is left out.
    """
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < max(n, 8):
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[:n, 1:].astype(np.float64)


def grams(raw: bytes, hash_bits: int) -> np.ndarray:
    """Hashes of all byte 1- to 4-grams of a text: ASCII letters lowered, runs of other ASCII are one space."""
    data = np.frombuffer(b" " + _SPACES(b" ", raw.lower()) + b" ", np.uint8).astype(np.uint32)
    found, key = [], np.zeros(len(data), np.uint32)
    shift = np.uint32(32 - hash_bits)
    for size in range(1, 5):
        if len(data) < size:
            break
        # The key of a longer gram extends the key that starts at the same byte.
        key = (key[: len(data) - size + 1] * np.uint32(257)) + data[size - 1 :] + np.uint32(1)
        if size > 1:
            found.append(((key + np.uint32(size)) * np.uint32(2654435761)) >> shift)
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def counted(raw: bytes, hash_bits: int) -> tuple[np.ndarray, int]:
    """How often each hash stands among the n-grams of a whole text, some megabytes at a time, and their number."""
    counts, n = np.zeros(1 << hash_bits, np.int64), 0
    for at in range(0, max(1, len(raw)), 1 << 20):
        # The last bytes of the portion before are taken again, so no n-gram is lost at a cut.
        part = grams(raw[max(0, at - 3) : at + (1 << 20)], hash_bits)
        counts += np.bincount(part, minlength=1 << hash_bits)
        n += len(part)
    return counts, n


def margins(raw: bytes, weights: np.ndarray, bias: np.ndarray, hash_bits: int) -> np.ndarray:
    """Mean weight of a text's n-grams for each bit."""
    counts, n = counted(raw, hash_bits)
    used = np.flatnonzero(counts)
    return counts[used] @ weights[used] / max(n, 1) * SCALE + bias


#: Margins are mean weights of a text's n-grams times this, so that text length does not matter.
SCALE = 20.0


def training_rows(docs: DataFrame, settings: Training) -> DataFrame:
    """(lang, draw, text) to learn from: of every language the rows with the smallest hashes, repeated ones once."""
    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("draw"))
    # Draws are uniform, so the smallest lie below their share of all; the margin is ten deviations and more.
    draws = materialize(labelled.select("lang", "draw").distinct(), "language-draws")
    sizes = draws.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    wanted = settings.rows_per_language + 10 * settings.rows_per_language**0.5 + 50
    place = F.col("draw").cast("double") / F.lit(2.0**64) + 0.5
    low = draws.join(F.broadcast(sizes), "lang").where(place * F.col("n") <= wanted)
    # Only those few are ranked, so no task reads a whole language; texts are fetched after it.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    first = low.select("lang", "draw").withColumn("rank", rank)
    first, seen = materialize_with(
        first.where(F.col("rank") <= settings.rows_per_language), "language-rows",
        {"languages": F.count_if(F.col("rank") == 1)},
    )
    each = max(1, min(settings.rows_per_language, settings.most_rows // max(1, seen.get("languages") or 0)))
    chosen = first.where(F.col("rank") <= each).select("lang", "draw")
    rows = labelled.join(F.broadcast(chosen), ["lang", "draw"])
    return rows.groupBy("lang", "draw").agg(F.min("text").alias("text"))


def examples(rows: DataFrame, hash_bits: int) -> DataFrame:
    """(lang, draw, part, used, counts): hashes and counts of the n-grams of whole texts and of their first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, draw, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "draw", "text")), strict=True):
                raw = text.encode()
                # First words alone, so that short texts are met in training too.
                for at, part in enumerate((raw, b" ".join(raw.split()[:8]), b" ".join(raw.split()[:2]))):
                    if _LETTER(part.decode(errors="ignore")):
                        counts, _ = counted(part, hash_bits)
                        used = np.flatnonzero(counts)
                        found.append((lang, draw, at, used.astype("<u4").tobytes(), counts[used].astype("<u4").tobytes()))
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "draw", "part", "used", "counts"])

    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return rows.select("lang", "draw", "text").mapInArrow(
        run, "lang string, draw long, part int, used binary, counts binary"
    )


#: Bits fitted together, and n-gram counts looked at together; both only bound memory.
BITS_AT_ONCE, ENTRIES = 64, 4_000_000


def train(docs: DataFrame, settings: Training = Training()) -> Model:
    """Fit all bits on the sample; the driver holds its n-gram counts and 2**hash_bits weights for each bit."""
    stored = materialize(examples(training_rows(docs, settings), settings.hash_bits), "language-examples")
    rows = sorted(
        (r.lang, r.draw, r.part, bytes(r.used), bytes(r.counts)) for r in stored.toLocalIterator()
    )
    languages = tuple(sorted({r[0] for r in rows}))
    codes = codewords(len(languages)) if languages else np.empty((0, 0))
    bits, size = codes.shape[1], 1 << settings.hash_bits
    weights, bias = np.zeros((size, bits)), np.zeros(bits)
    if len(languages) < 2:
        return Model(languages, codes, weights, bias, np.ones(bits), settings.ambiguous_below)
    known = {lang: i for i, lang in enumerate(languages)}
    owner = np.array([known[r[0]] for r in rows])
    # Every language weighs the same, however many rows it has.
    share = (1.0 / np.bincount(owner, minlength=len(languages))[owner] / len(languages))[:, None]
    portions = _portions([(r[3], r[4]) for r in rows])
    del rows
    wrong = np.zeros(bits)
    for low in range(0, bits, BITS_AT_ONCE):
        # Each bit is a classifier of its own.
        part = slice(low, low + BITS_AT_ONCE)
        target = codes[owner][:, part]
        learned, shift = np.zeros((size, target.shape[1])), np.zeros(target.shape[1])
        pace = np.full(learned.shape, 1e-8)
        for _ in range(settings.passes):
            gradient, moved = -1e-6 * learned, np.zeros(len(shift))
            for at, entries in portions:
                row, column, value = _entries(entries)
                aim = target[at]
                margin = _times(row, column, value, learned, len(aim)) + shift
                push = share[at] * aim / (1.0 + np.exp(np.clip(aim * margin, -50, 50)))
                gradient += _times(column, row, value, push, size)
                moved += push.sum(axis=0)
            pace += gradient**2
            learned += 0.5 * gradient / np.sqrt(pace)
            shift += 0.5 * moved
        for at, entries in portions:
            row, column, value = _entries(entries)
            margin = _times(row, column, value, learned, len(target[at])) + shift
            wrong[part] += ((margin * target[at] <= 0) * share[at]).sum(axis=0)
        weights[:, part], bias[part] = learned, shift
    # A bit that is right more often weighs more (log odds of being right).
    trust = np.log((1.0 - wrong + 0.01) / (wrong + 0.01))
    trust = np.maximum(trust, 0.05)
    return Model(languages, codes, weights, bias, trust / trust.mean(), settings.ambiguous_below)


def _portions(counts: list[tuple[bytes, bytes]]) -> list[tuple[slice, list[tuple[bytes, bytes]]]]:
    """The examples in runs of about ``ENTRIES`` counts, each with its place."""
    found, start, held = [], 0, 0
    for i, (used, _) in enumerate(counts):
        held += len(used) // 4
        if held >= ENTRIES or i + 1 == len(counts):
            found.append((slice(start, i + 1), counts[start : i + 1]))
            start, held = i + 1, 0
    return found


def _entries(counts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of every count of some examples; a row's values sum to ``SCALE``."""
    sizes = [len(used) // 4 for used, _ in counts]
    row = np.repeat(np.arange(len(counts)), sizes)
    column = np.frombuffer(b"".join([used for used, _ in counts]), "<u4").astype(np.int64)
    value = np.frombuffer(b"".join([n for _, n in counts]), "<u4").astype(np.float64)
    sums = np.bincount(row, weights=value, minlength=len(counts))
    return row, column, value / np.maximum(sums, 1)[row] * SCALE


def _times(row: np.ndarray, column: np.ndarray, value: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """Sparse (row, column, value) times a dense matrix, one column at a time."""
    return np.stack(
        [np.bincount(row, weights=value * dense[column, b], minlength=n) for b in range(dense.shape[1])], axis=1
    )


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; only ``text`` is looked at."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    # Under twice languages x 2**hash_bits numbers, whatever the input.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        bits = max(1, len(model.weights)).bit_length() - 1
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            judged = [i for i, t in enumerate(texts) if t and model.languages and _LETTER(t)]
            best = np.full(len(texts), len(model.languages))
            score = np.zeros(len(texts))
            if judged:
                found = np.stack([margins(texts[i].encode(), model.weights, model.bias, bits) for i in judged])
                shares = model.scores(found)
                best[judged] = shares.argmax(axis=1)
                score[judged] = shares.max(axis=1)
            ambiguous = (best < len(model.languages)) & (score < model.ambiguous_below)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(ambiguous)],
                names=[*batch.schema.names, "lang_pred", "score", "ambiguous"],
            )

    added = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
