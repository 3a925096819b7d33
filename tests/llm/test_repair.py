"""Conversation repair beside a plain search through all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from parcelflow.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n string, fault string"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows of ``(conv, turn, role, text)`` after damage; conversations without rows stay known."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows, order):
    """Figures, cheapest edits and repaired lines of one damaged conversation, by trying everything."""
    rows = sorted(rows, key=order)
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    ok = re.compile("(s?(ua)+)?")

    @cache
    def best(i, state):
        """Cheapest (cost, letters, lines) from row i on; the state is the last initial."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            _, role, text = rows[i]
            c, a, o = best(i + 1, state)
            ways.append((c + 3, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                for letter, name in (("K", role), ("R", "user"), ("R", "assistant")):
                    if follows(state, name[:1]):
                        c, a, o = best(i + 1, name[:1])
                        ways.append((c + late + 2 * (letter == "R"), letter + a, (f"{name}:{text}", *o)))
        for depth in (1, 2):  # inserts before this row, or at the end
            to, names = state, []
            for _ in range(depth):
                to = "a" if to == "u" else "u"
                names.append("user:" if to == "u" else "assistant:")
            for c, a, o in at(i, to):
                ways.append((c + 2 * depth, "I" * depth + a, (*names, *o)))
        return min(ways)

    def at(i, state):
        """As ``best`` without another insert."""
        if i == len(rows):
            return [(0, "", ())] if state in ("", "a") else []
        _, role, text = rows[i]
        c, a, o = best(i + 1, state)
        ways = [(c + 3, "D" + a, o)]
        if faults[i] not in ("blank", "duplicate"):
            late = faults[i] == "truncated"
            for letter, name in (("K", role), ("R", "user"), ("R", "assistant")):
                if follows(state, name[:1]):
                    c, a, o = best(i + 1, name[:1])
                    ways.append((c + late + 2 * (letter == "R"), letter + a, (f"{name}:{text}", *o)))
        return ways

    def follows(state, initial):
        return initial and (state + initial in ("su", "ua", "au", "u", "s"))

    cost, audit, lines = best(0, "")
    assert ok.fullmatch("".join(x[:1] for x in lines))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_turn(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, text)


def conversations(noise, count, longest, ties=False):
    roles = ["user", "assistant", "system", "tool", "", None, "unclear"]
    texts = ["yes.", "no!", "what?", "cut", "", " \t", None, "é🎉.", ". ", "a" * 3000 + "."]
    rows = []
    for conv in range(count):
        turns = list(range(noise.randint(0, 3), longest))
        for turn in noise.sample(turns, noise.randint(0, len(turns))):
            good = noise.random() < 0.6
            role = ("user", "assistant")[turn % 2] if good else noise.choice(roles)
            rows.append((conv, turn, role, noise.choice(texts) if noise.random() < 0.4 else f"text {noise.randint(0, 9)}."))
    return rows + [(None, 3, "user", "hello."), (None, None, None, None), (7, None, "system", "be kind."), (count, None, "user", "x")]


@pytest.mark.parametrize("block,spread", [(256, 8), (3, 8), (1, 3)])
def test_equals_plain_search(monkeypatch, spark, block, spread):
    noise = random.Random(block)
    rows = conversations(noise, 120, 9) + [(1000, t, r, f"t{t % 30}.") for t, r in zip(range(60), ["user", "user", "assistant", "tool"] * 15)]
    monkeypatch.setattr(repair, "BLOCK", block)
    spark.conf.set("spark.sql.shuffle.partitions", str(spread))
    try:
        got = repair.repair_report(spark.createDataFrame([(*r, "c", "n", None) for r in rows], SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = [(conv, *plain(kept, by_turn)) for conv, kept in damage(rows).items()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_equal_rows_and_nothing(spark):
    """Copies of a row at one place: one stays, the others go; an empty table gives no rows."""
    rows = [(5, 1, "user", "hi.")] * 700 + [(5, 2, "assistant", "ok.")] * 3 + [(5, 3, "user", "hi.")]
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    got = repair.repair_report(frame).collect()
    assert [tuple(r) for r in got] == [(conv, *plain(kept, by_turn)) for conv, kept in damage(rows).items()]
    assert repair.repair_report(frame.limit(0)).count() == 0


def test_messages(spark):
    rows = [("c", t, r, x, 1) for t, r, x in [(0, "system", "s."), (1, "user", "a."), (2, "user", "b"), (3, "x", "c.")]]
    frame = spark.createDataFrame(rows, "conv string, turn long, role string, text string, n long")
    done = repair.Repair(frame)
    report, messages = done.report().first(), done.messages().orderBy("block", "at").collect()
    assert (report.audit, report.cost) == ("KKDR", 5)
    assert [(m.role, m.text, m.edit) for m in messages] == [("system", "s.", "K"), ("user", "a.", "K"), ("assistant", "c.", "R")]


def test_weights_order_as_cost_and_letters():
    weights = repair.Weights(5)
    noise = random.Random(1)
    paths = [(noise.randrange(4), "".join(noise.choice("DIKR") for _ in range(noise.randrange(6)))) for _ in range(400)]
    assert sorted(paths) == [weights.read(w) for w in sorted(weights.make(*p) for p in paths)]
    for cost, letters in paths:
        if len(letters) < 5:
            assert weights.read(weights.before(repair.DIGIT["K"], 2, weights.make(cost, letters))) == (cost + 2, "K" + letters)


def test_long_conversation_is_dealt_to_tasks(spark):
    """The rows of one conversation lie in many partitions, and its digest and audit are those of the whole."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(4000)]
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    done = repair.Repair(repair.damaged(frame))
    blocks = done.blocks.selectExpr("block >> 33 AS task", "size(rows) AS n").collect()
    assert len({b.task for b in blocks}) >= 6 and max(b.n for b in blocks) <= repair.BLOCK
    kept = damage(rows)[1]
    audit = done.report().first().audit
    assert audit.count("D") + audit.count("K") + audit.count("R") == len(kept)
    lines = [f"{m.role}:{m.text}" for m in done.messages().orderBy("block", "at").collect()]
    assert done.digests().first().repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
