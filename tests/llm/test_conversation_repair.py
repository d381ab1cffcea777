"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loamstone.llm import conversation_repair as cr

SPACES = set(" \t\n\x0b\x0c\r")
LEGAL = {"su", "ua", "au"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def expected(rows):
    """A report by dynamic programming over whole audits, least cost and then least audit for each state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = [c for c in text if c not in SPACES]
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    # state -> (cost, audit, lines); states: rows so far, and the last role
    best = {0: (0, "", ())}
    after = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    full = {"u": "user", "a": "assistant"}

    def insertions(found):
        for _ in range(3):
            for s, (c, a, lines) in list(found.items()):
                r, t = after[s]
                x = (c + 2, a + "I", (*lines, f"{full[r]}:"))
                if t not in found or x[:2] < found[t][:2]:
                    found[t] = x
        return found

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def offer(t, x):
            if t not in new or x[:2] < new[t][:2]:
                new[t] = x

        plain = dict(best)
        for s, (c, a, lines) in insertions(best).items():
            offer(s, (c + 3, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            r, t = after[s]
            offer(t, (c + 2 + more, a + "R", (*lines, f"{full[r]}:{text}")))
            i = role[:1]
            if i == "s" and s == 0 or i == "u" and s in (0, 1, 3) or i == "a" and s == 2:
                offer({"s": 1, "u": 2, "a": 3}[i], (c + more, a + "K", (*lines, f"{role}:{text}")))
        assert plain is not best
        best = new
    ends = insertions(best)
    cost, audit, lines = min((ends[s] for s in (0, 3) if s in ends), key=lambda x: x[:2])
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        n = 700 if conv in (7, None) else rng.randint(0, 12)
        for turn in range(n):
            role = rng.choice(["system"] * (turn < 2) + ["user", "assistant", "user", "assistant", "user", "assistant", "tool", "", None, "s", "student"])
            text = rng.choice(["Yes.", "no", "Well?", "Good! ", "tail \n", " \t", "", None, *[f"text {rng.randint(0, 999)}" + rng.choice(["", ".", "!\r"]) for _ in range(12)]])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [rows[5]] * 3 + [(70, None, "user", "Hi.")] * 4 + [(71, 3, "assistant", ""), (72, None, None, None)]
    return rows


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_reports(spark, coalesce):
    rows = conversations(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)  # without it one conversation spans several ranges
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, range int").repartition(5)
        found = cr.reports(cr.damaged(df), df.select(F.col("conv_id").alias("conv"))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in damage(rows):
        by.setdefault(r[0], []).append(r)
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        assert tuple(r)[1:] == expected(by.get(r.conv, [])), r.conv


def test_divide_and_conquer_is_audit_least():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 5, 9, 30, 400]:
        for _ in range(40):
            kinds = bytes(rng.randrange(8) for _ in range(n))
            edits, last = cr.solved(kinds, 0, cr.END)
            audit = "".join(edits) + "I" * len(cr.REST[last])
            rows = [(1, k, ["system", "user", "assistant", "tool"][x >> 1], f"{k}" + ("" if x & 1 else ".")) for k, x in enumerate(kinds)]
            assert audit == expected(rows)[-2]


def test_repaired_rows_and_empty_tables(spark):
    schema = "conv long, turn long, role string, text string"
    df = spark.createDataFrame([(1, 1, "assistant", "Fine."), (1, 0, "system", "Be kind."), (2, 5, "user", "")], schema)
    assert sorted(map(tuple, cr.repaired(df).collect())) == [(1, 0, "system", "Be kind."), (1, 1, "user", ""), (1, 2, "assistant", "Fine.")]
    empty = spark.createDataFrame([], schema)
    assert cr.reports(empty, empty).count() == 0
    assert tuple(cr.reports(empty, df).where("conv = 2").first())[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
