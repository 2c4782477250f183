import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gatewarden.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def harmed(rows):
    """Damage as the contract words it, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        out += [row] * (2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all sequences of edits, by plain recursion from the last row."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        blank, again = not text.strip(SPACE), (role, text) in seen
        seen.add((role, text))
        kinds.append(("blank" if blank else "duplicate" if again else "truncated" if text.strip(SPACE)[-1] not in ".!?" else "", role, text))
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {state: (0, "", []) if state in ("", "a") else (10**9, "", []) for state in steps}

    def inserted(best):
        for _ in range(4):
            for state in steps:
                for i, to in steps[state].items():
                    if i != "s":
                        c, a, r = best[to]
                        best[state] = min(best[state], (c + 5, "I" + a, [("user" if i == "u" else "assistant") + ":"] + r))
        return best

    best = inserted(best)
    for kind, role, text in reversed(kinds):
        now = {}
        for state in steps:
            c, a, r = best[state]
            options = [(c + 2, "D" + a, r)]
            if kind not in ("blank", "duplicate"):
                more = 5 if kind == "truncated" else 0
                if role[:1] in steps[state]:
                    c, a, r = best[steps[state][role[:1]]]
                    options.append((c + more, "K" + a, [f"{role}:{text}"] + r))
                for i, name in (("u", "user"), ("a", "assistant")):
                    if i in steps[state]:
                        c, a, r = best[i]
                        options.append((c + 1 + more, "R" + a, [f"{name}:{text}"] + r))
            now[state] = min(options)
        best = inserted(now)
    return best[""], [k for k, _, _ in kinds]


def plain(rows, order):
    out = {}
    for conv in {r[0] for r in rows}:
        left = sorted((r for r in harmed([r for r in rows if r[0] == conv])), key=order)
        (cost, audit, lines), kinds = cheapest(left)
        turns = {r[1] for r in left if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(left, left[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def order_of(spark, rows):
    """The stated order of equal turns: role, then the hashes of role and text."""
    names = spark.createDataFrame(sorted({(r or "", t or "") for _, _, r, t in harmed(rows)}), "role string, text string")
    place = {(r.role, r.text): (r.a, r.b) for r in names.select("role", "text", *conversations._hashes()).collect()}
    return lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), place[(r[2], r[3])])


def check(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"cost": F.lit("clash"), "part": F.lit(1)})
    found = {r[0]: tuple(r)[1:] for r in conversations.repaired(conversations.damaged(table)).collect()}
    assert found == plain(rows, order_of(spark, rows))


def made(seed, convs, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Why? ", "Ünïcode…", "a.b", "Fine.\n", "x" * 3000 + "."]
    return [
        (None if c == 0 else c, None if draw.random() < 0.05 else draw.randint(0, 9), draw.choice(roles), draw.choice(texts) if draw.random() < 0.4 else f"t{draw.random()}.")
        for c in range(convs) for _ in range(draw.randint(1, longest))
    ]


def test_matches_a_plain_version(spark):
    check(spark, made(1, 150, 9))


@pytest.mark.parametrize("least", [1, 4])
def test_long_conversations_over_many_blocks(spark, monkeypatch, least):
    monkeypatch.setattr(conversations, "LEAST_BLOCK", least)
    draw = random.Random(2)
    role = lambda i: draw.choice(["user", "assistant", "assistant" if i % 2 else "user"])
    hot = [(7, i, role(i), draw.choice(["ok.", "same", f"row {i}."])) for i in range(400)]
    equal = [(8, 3, "user", "again.")] * 300 + [(8, 4, "assistant", "done.")]
    check(spark, hot + equal + made(3, 40, 6))


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "Hello."), (1, 5, "user", "a."), (1, 9, "assistant", "b.")])
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repaired(conversations.damaged(empty)).collect() == []


def test_every_short_sequence_of_kinds(spark):
    """All sequences of up to three kinds of rows, undamaged, against plain recursion."""
    kinds = [("system", "S{}."), ("user", "U{}."), ("assistant", "A{}."), ("user", "cut{}"), ("tool", "T{}."), ("user", "")]
    rows, conv = [], 0
    for n in (1, 2, 3):
        for several in itertools.product(kinds, repeat=n):
            conv += 1
            rows += [(conv, i, role, text.format(i)) for i, (role, text) in enumerate(several)]
    found = {r.conv_id: r for r in conversations.repaired(conversations.as_given(spark.createDataFrame(rows, SCHEMA))).collect()}
    for key, several in itertools.groupby(rows, key=lambda r: r[0]):
        (cost, audit, lines), _ = cheapest(list(several))
        assert (found[key].cost, found[key].audit) == (cost, audit)
        assert found[key].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
