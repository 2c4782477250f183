"""Conversations brought back to the form ``(s?(ua)+)?`` of role initials by the cheapest edits.

A conversation's rows are edited in order. With a state for what has been kept so far (nothing, a
system row, a user row, an assistant row), the cheapest edits from a row on are four costs, one per
state: the *backward vector* of that row. The dynamic program stores them only at checkpoints, one
per about square root of the rows, and recomputes a block's vectors while it walks forward through
the block, taking at every step the ASCII-least letter among the edits that are tight, that is,
whose cost and the rest's add up to the vector's. The walk emits the least of all cheapest edits.

Rows are sorted by range, so that a conversation of any length is dealt over many tasks. Every task
cuts its range into blocks of at most the square root of all rows. A conversation that lies within
one task's range is finished there. The other blocks are reduced to what they cost from every state
to every state (16 numbers); from these, the vectors at all block ends (the checkpoints) follow per
conversation, each block is walked once from each state, and the chain of states picks one walk per
block. Texts take no part in this: what travels is hashes and lengths. Only the repaired
conversation itself, whose digest covers all its text in order, is streamed through one task per
conversation, one row at a time.

Costs: Keep 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or assistant row) 5;
a truncated row that is not deleted adds 5; blank rows and duplicates must be deleted.

Defined results
    null conv_id           a conversation like any other (all its rows together)
    null turn              before all others
    null role or text      one space: such a role fits nothing, such a text is blank
    equal turns            by role, then by hash of role and text; equal rows stay together
    repeated rows          every copy after the first is a duplicate
    empty or very long texts   blank, or like any other
    no rows left           zeros, an empty audit, the digest of the empty string
    extra columns          ignored
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from gatewarden.plans.durable import materialize, materialize_with, release
from gatewarden.plans.joins import skew_join

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
#: A block has this many rows at least; above that, the square root of all rows.
LEAST_BLOCK = 256

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Where a user or assistant row (the only one of the two that fits) leads from each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Where a row that keeps its role leads, by its initial and the state.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
END = (0, NEVER, NEVER, 0)
LEGAL = {"su", "ua", "au"}
DROPPED_SPACE = " \\t\\n\\u000b\\u000c\\r"

Vector = tuple[int, int, int, int]
#: A run of equal rows: initial, must the first be deleted, is it truncated, how many.
Run = tuple[str, bool, bool, int]


# ---------------------------------------------------------------- the dynamic program


def _with_inserts(costs: Vector) -> Vector:
    """Costs where rows may be inserted first; from any state two inserts reach all that inserts can."""
    for _ in range(2):
        costs = tuple(min(costs[s], costs[NEXT[s]] + INSERT) for s in STATES)
    return tuple(min(c, NEVER) for c in costs)


def _later(costs: Vector, deleted: int) -> Vector:
    """Costs with so many deletions before."""
    return tuple(c + DELETE * deleted if c < NEVER else NEVER for c in costs) if deleted else costs


def _steps(kind: tuple[str, bool, bool], state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that consume a row, in ASCII order."""
    initial, gone, truncated = kind
    found = [("D", DELETE, state)]
    if not gone:
        more = TRUNCATED if truncated else 0
        if state in KEPT.get(initial, ()):
            found.append(("K", KEEP + more, KEPT[initial][state]))
        found.append(("R", REROLE + more, NEXT[state]))
    return found


class Program:
    """Backward vectors and forward walks; both depend on a vector's shape only, so each shape is worked out once."""

    def __init__(self):
        self._back: dict[tuple, tuple[Vector, int]] = {}
        self._walk: dict[tuple, tuple[str, int]] = {}

    @staticmethod
    def _shape(vector: Vector) -> tuple[Vector, int]:
        least = min(vector)
        if least >= NEVER:
            return vector, 0
        return tuple(v - least if v < NEVER else NEVER for v in vector), least

    def before(self, kind: tuple[str, bool, bool], after: Vector) -> Vector:
        """The vector before a row, from the one behind it."""
        shape, base = self._shape(after)
        known = self._back.get((kind, shape))
        if known is None:
            costs = tuple(min(cost + shape[to] for _, cost, to in _steps(kind, s)) for s in STATES)
            known = self._back[(kind, shape)] = self._shape(_with_inserts(costs))
        costs, more = known
        return tuple(c + base + more if c < NEVER else NEVER for c in costs)

    def before_run(self, run: Run, after: Vector) -> Vector:
        """The vector before a run: copies after the first are deleted, whatever the state."""
        return self.before(run[:3], _later(after, run[3] - 1))

    def letters(self, kind: tuple[str, bool, bool], after: Vector, state: int) -> tuple[str, int]:
        """The ASCII-least tight edits up to and with this row, from a state."""
        shape, _ = self._shape(after)
        known = self._walk.get((kind, shape, state))
        if known is None:
            known = self._walk[(kind, shape, state)] = self._least(kind, shape, state)
        return known

    def _least(self, kind: tuple[str, bool, bool], after: Vector, state: int) -> tuple[str, int]:
        here = _with_inserts(tuple(min(cost + after[to] for _, cost, to in _steps(kind, s)) for s in STATES))
        audit = ""
        while True:
            tight = {letter: to for letter, cost, to in _steps(kind, state) if cost + after[to] == here[state]}
            if here[NEXT[state]] + INSERT == here[state]:
                tight["I"] = NEXT[state]
            letter = min(tight)
            audit, state = audit + letter, tight[letter]
            if letter != "I":
                return audit, state

    def walk(self, runs: list[Run], end: Vector, state: int) -> tuple[str, int, Vector]:
        """Edits of a block from a state, given the vector at its end; the state it ends in; the vector at its start.

        Backward vectors are kept at checkpoints only; the vectors between two of them are recomputed.
        """
        every = max(1, math.isqrt(len(runs)))
        stops = range(0, len(runs), every)
        kept = {}
        for first in reversed(stops):
            kept[first] = end
            end = self.costs(runs[first : first + every], end)
        audit = []
        for first in stops:
            part, behind = runs[first : first + every], [kept[first]]
            for run in reversed(part[1:]):
                behind.append(self.before_run(run, behind[-1]))
            for run, after in zip(part, reversed(behind), strict=True):
                letters, state = self.letters(run[:3], _later(after, run[3] - 1), state)
                # Further copies are deleted at once: D is the least letter.
                audit.append(letters + "D" * (run[3] - 1))
        return "".join(audit), state, end

    @staticmethod
    def at_end(state: int) -> str:
        """What is inserted after the last row."""
        last, audit = _with_inserts(END), ""
        while last[state]:
            audit, state = audit + "I", NEXT[state]
        return audit

    def costs(self, runs: list[Run], end: Vector) -> Vector:
        for run in reversed(runs):
            end = self.before_run(run, end)
        return end


# ---------------------------------------------------------------- rows


def as_given(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows as they are."""
    return rows.select("conv_id", F.col("turn").cast("long"), *_filled(rows), F.lit(1).alias("copies"))


def _filled(rows: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 leaves no copy, 1 empties the text, 2 removes its marks, 3 leaves two copies, 4 makes the role user.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    whole = rows.select("conv_id", F.col("turn").cast("long"), *_filled(rows), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return whole.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )


def _hashes() -> list[Column]:
    return [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b")]


def _runs(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text), the text as two hashes, with its number of copies."""
    trimmed = F.expr(f"trim(TRAILING '{DROPPED_SPACE}' FROM text)")
    keyed = rows.select(
        "conv_id", "turn", "role", "copies",
        *_hashes(),
        (F.length(trimmed) == 0).alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    return keyed.groupBy("conv_id", "turn", "role", "a", "b", "blank", "truncated").agg(F.sum("copies").alias("n"))


def _placed(runs: DataFrame) -> DataFrame:
    """Runs with ``later``: the same role and text was seen at an earlier turn."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = runs.where(F.col("n") > 0).groupBy("conv_id", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns"))
    # A null conversation gets its own key, since nulls join nothing.
    shown = [F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id")]
    again = materialize(firsts.where(F.col("turns") > 1).select(*shown, "a", "b", "first"), "conversations-again")
    found = skew_join(runs.select("*", *shown), again, ["no_id", "id", "a", "b"], "left", spread_by=["turn"])
    return found.withColumn("later", F.coalesce(place > F.col("first"), F.lit(False))).drop("no_id", "id", "first")


def _facts(runs: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of every conversation, two sums deep so that a hot one is combined early."""
    n, alive = F.col("n"), F.col("n") > 0
    first = F.when(alive & ~F.col("blank"), 1).otherwise(0)
    per_turn = runs.groupBy("conv_id", "turn").agg(
        F.max(alive).alias("alive"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("later"), n).otherwise(n - first)).alias("duplicate"),
        F.sum(F.when(F.col("truncated") & ~F.col("later"), first).otherwise(0)).alias("truncated"),
    )
    turn = F.when(F.col("alive"), F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0))
    return per_turn.groupBy("conv_id").agg(
        gaps.cast("long").alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    )


# ---------------------------------------------------------------- blocks

_CODED = "part int, block int, whole boolean, cost long, audit string, first string, last string, illegal long, runs binary, costs array<long>"


def _code(runs: list[Run]) -> bytes:
    return "\n".join(f"{r[0]}\t{r[1]:d}\t{r[2]:d}\t{r[3]}" for r in runs).encode()


def _decode(coded: bytes) -> list[Run]:
    fields = (line.split("\t") for line in coded.decode().split("\n"))
    return [(i, gone == "1", cut == "1", int(n)) for i, gone, cut, n in fields]


def _illegal(runs: list[Run]) -> int:
    pairs = sum(a[0] + b[0] not in LEGAL for a, b in zip(runs, runs[1:]))
    return pairs + sum(r[3] - 1 for r in runs)


def _blocks(id_type: pa.DataType, most: int):
    """Arrow function over sorted runs: finished conversations, and the blocks of those that may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, part = Program(), TaskContext.get().partitionId()
        out: list[list] = [[] for _ in range(11)]

        def put(conv, block, runs, whole):
            cost, audit, coded, costs = None, None, None, None
            if whole:
                audit, state, costs_before = program.walk(runs, _with_inserts(END), START)
                audit += program.at_end(state)
                cost = costs_before[START]
            else:
                coded, costs = _code(runs), []
                for t in STATES:
                    costs += program.costs(runs, tuple(0 if s == t else NEVER for s in STATES))
            row = (conv, part, block, whole, cost, audit, runs[0][0], runs[-1][0], _illegal(runs), coded, costs)
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def flush():
            types = [id_type, pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            names = ["conv_id", *(c.split()[0] for c in _CODED.split(", "))]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
            for column in out:
                column.clear()
            return batch

        nothing = object()
        conv, runs, block, first = nothing, [], 0, True
        for batch in batches:
            for i, initial, gone, truncated, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "gone", "cut", "n"))):
                if conv is nothing or i != conv:
                    if runs:
                        # The first conversation of the range may have begun elsewhere.
                        put(conv, block, runs, not first and block == 0)
                        first = False
                    conv, runs, block = i, [], 0
                elif len(runs) >= most:
                    put(conv, block, runs, False)
                    runs, block = [], block + 1
                runs.append((initial, gone, truncated, n))
            if out[0]:
                yield flush()
        if runs:
            # The last conversation of the range may go on elsewhere.
            put(conv, block, runs, False)
        if out[0]:
            yield flush()

    return run


def _ends(id_type: pa.DataType):
    """Arrow function over one conversation's blocks: the backward vector at each block's end, and the whole cost."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("block", "ascending")])
        vector, ends = _with_inserts(END), []
        for costs in reversed(table.column("costs").to_pylist()):
            ends.append(list(vector))
            to = [costs[4 * t : 4 * t + 4] for t in STATES]
            vector = tuple(min(min(to[t][s] + vector[t] for t in STATES), NEVER) for s in STATES)
        last = [i == table.num_rows - 1 for i in range(table.num_rows)]
        return pa.table(
            {
                "conv_id": table.column("conv_id").cast(id_type),
                "part": table.column("part"),
                "block": table.column("block"),
                "ending": pa.array(ends[::-1], pa.list_(pa.int64())),
                "total": pa.array([vector[START]] * table.num_rows, pa.int64()),
                "final": pa.array(last, pa.bool_()),
            }
        )

    return run


def _walks(id_type: pa.DataType):
    """Arrow function over blocks and their end vectors: the walk from every state, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program()
        for batch in batches:
            rows = []
            for b in batch.select(["conv_id", "part", "block", "runs", "ending", "final"]).to_pylist():
                runs, end = _decode(b["runs"]), tuple(b["ending"])
                for state in STATES:
                    audit, to, _ = program.walk(runs, end, state)
                    if b["final"]:
                        audit += program.at_end(to)
                    rows.append((b["conv_id"], b["part"], b["block"], state, to, audit))
            types = [id_type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            names = ["conv_id", "part", "block", "state", "to", "audit"]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _chain(id_type: pa.DataType):
    """Arrow function over one conversation's walks (without audits): the state that each block is entered in."""

    def run(table: pa.Table) -> pa.Table:
        leads: dict[tuple[int, int], dict[int, int]] = {}
        for w in table.to_pylist():
            leads.setdefault((w["part"], w["block"]), {})[w["state"]] = w["to"]
        state, rows = START, []
        for place in sorted(leads):
            rows.append((*place, state))
            state = leads[place][state]
        parts, blocks, states = zip(*rows, strict=True)
        conv = pa.array([table.column("conv_id")[0].as_py()] * len(rows), id_type)
        return pa.table({"conv_id": conv, "part": pa.array(parts, pa.int32()), "block": pa.array(blocks, pa.int32()), "state": pa.array(states, pa.int32())})

    return run


def _audits(placed: DataFrame, total: int) -> DataFrame:
    """(conv_id, part, block, audit, cost, first, last, illegal): pieces of every conversation's audit, in order."""
    id_type = placed.schema["conv_id"].dataType
    arrow_id, ddl = _arrow(id_type), id_type.simpleString()
    coded = placed.where(F.col("n") > 0).select(
        "conv_id", "turn", "role", "a", "b", F.col("n").cast("long").alias("n"),
        F.translate(F.left("role", F.lit(1)), "\t\n", "  ").alias("initial"),
        (F.col("blank") | F.col("later")).alias("gone"), F.col("truncated").alias("cut"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "a", "b"]
    spread = coded.repartitionByRange(_partitions(placed), *order).sortWithinPartitions(*order)
    blocks = spread.select("conv_id", "initial", "gone", "cut", "n").mapInArrow(
        _blocks(arrow_id, max(LEAST_BLOCK, math.isqrt(total))), f"conv_id {ddl}, {_CODED}"
    )
    stored = materialize(blocks, "conversations-blocks")
    pieces = ["conv_id", "part", "block", "audit", "cost", "first", "last", "illegal"]
    parts = stored.where(~F.col("whole"))
    ends = materialize(
        parts.select("conv_id", "part", "block", "costs").groupBy("conv_id").applyInArrow(
            _ends(arrow_id), f"conv_id {ddl}, part int, block int, ending array<long>, total long, final boolean"
        ),
        "conversations-ends",
    )
    # A block is known by its task and number within it (a task's first and second conversation differ in both).
    at = ["part", "block", "key"]
    key = F.xxhash64("conv_id").alias("key")
    walks = materialize(
        parts.select("*", key).join(ends.select("part", "block", "ending", "final", key), at).mapInArrow(
            _walks(arrow_id), f"conv_id {ddl}, part int, block int, state int, to int, audit string"
        ),
        "conversations-walks",
    )
    entered = walks.select("conv_id", "part", "block", "state", "to").groupBy("conv_id").applyInArrow(
        _chain(arrow_id), f"conv_id {ddl}, part int, block int, state int"
    )
    chosen = walks.select("part", "block", "state", "audit", key).join(entered.select("part", "block", "state", key), [*at, "state"])
    chained = (
        parts.drop("audit", "cost").select("*", key)
        .join(chosen.drop("state"), at)
        .join(ends.select("part", "block", F.col("total").alias("cost"), key), at)
    )
    return stored.where("whole").select(*pieces).unionByName(chained.select(*pieces))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _arrow(id_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(id_type)


# ---------------------------------------------------------------- repaired conversations

#: Facts (kind 0), pieces of the audit (kind 1) and rows (kind 2) of conversations, sorted in this order.
_STREAM = (
    "kind int, gaps long, blank long, duplicate long, truncated long, part int, block int, audit string, cost long, "
    "first string, last string, illegal long, turn long, role string, a long, b long, text string"
)
_NAMES = [c.split()[0] for c in _STREAM.split(", ")]


def _repaired(id_type: pa.DataType):
    """Arrow function over the sorted stream: one row per conversation, of whose text one row is held at a time."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    class Open:
        def __init__(self, conv, facts):
            self.conv, self.facts, self.audit, self.at = conv, facts, [], 0
            self.illegal = self.cost = 0
            self.last, self.state, self.digest, self.empty = None, START, hashlib.sha256(), True
            self.edits = ""

        def piece(self, r):
            if self.last is not None:
                self.illegal += self.last + r["first"] not in LEGAL
            else:
                self.cost = r["cost"]
            self.last = r["last"]
            self.illegal += r["illegal"]
            self.audit.append(r["audit"])

        def say(self, role, text):
            self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

        def inserts(self):
            while self.at < len(self.edits) and self.edits[self.at] == "I":
                self.say("assistant" if self.state == USER else "user", "")
                self.state, self.at = NEXT[self.state], self.at + 1

        def row(self, role, text):
            if not self.edits:
                self.edits = "".join(self.audit)
            self.inserts()
            edit, self.at = self.edits[self.at], self.at + 1
            if edit == "K":
                self.say(role, text)
                self.state = KEPT[role[:1]][self.state]
            elif edit == "R":
                self.say("assistant" if self.state == USER else "user", text)
                self.state = NEXT[self.state]

        def result(self):
            self.edits = self.edits or "".join(self.audit)
            self.inserts()
            if self.at != len(self.edits):
                raise RuntimeError(f"edits of conversation {self.conv} do not fit its rows")
            return (self.conv, *self.facts, self.illegal, self.cost, self.edits, self.digest.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["conv_id", *counts, "audit", "repaired_sha256"]
        here: Open | None = None
        for batch in batches:
            done = []
            # Only what a kind needs is turned into Python values.
            conv, kind, role, text = (batch.column(c) for c in ("conv_id", "kind", "role", "text"))
            kinds = kind.to_pylist()
            for i, k in enumerate(kinds):
                if k == 2:
                    here.row(role[i].as_py(), text[i].as_py())
                elif k == 1:
                    here.piece({c: batch.column(c)[i].as_py() for c in ("audit", "cost", "first", "last", "illegal")})
                else:
                    if here is not None:
                        done.append(here.result())
                    here = Open(conv[i].as_py(), [batch.column(c)[i].as_py() for c in counts[:4]])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(here.result(), types, strict=True)], names=names)

    return run


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation of ``rows`` (as from ``as_given`` or ``damaged``).

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)
    """
    id_type = rows.schema["conv_id"].dataType
    runs, seen = materialize_with(_runs(rows), "conversations-runs", {"n": F.count(F.lit(1))})
    placed = materialize(_placed(runs), "conversations-placed")
    release(runs)
    facts = _facts(placed)
    audits = _audits(placed, int(seen.get("n") or 0))
    # As often as there are copies, so that rows and letters keep step.
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    texts = rows.select("conv_id", "turn", "role", "text", *_hashes(), copies.alias("copy"))

    def stream(df: DataFrame, kind: int) -> DataFrame:
        types = dict(c.split() for c in _STREAM.split(", "))
        known = {**{c: F.col(c) for c in df.columns}, "kind": F.lit(kind)}
        return df.select("conv_id", *[known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in _NAMES])

    whole = stream(facts, 0).union(stream(audits, 1)).union(stream(texts, 2))
    order = ["conv_id", "kind", "part", "block", F.col("turn").asc_nulls_first(), "role", "a", "b"]
    dealt = whole.repartition(_partitions(rows), "conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(
        _repaired(_arrow(id_type)),
        f"conv_id {id_type.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string",
    )
