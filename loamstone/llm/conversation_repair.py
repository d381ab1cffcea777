"""Structure repair of conversations by Hirschberg's divide and conquer over four states.

A repaired conversation is empty, or an optional system row and then user and assistant rows in turn. The cheapest edits are a shortest path through four
states (nothing yet, after system, after user, after assistant): a row is kept, gets another role or is deleted, and empty rows are inserted. A
segment of rows is cut in the middle; the cost vector of the states from its start meets the one from its end, and among the states that an optimal path
may cross the audit-least one is the one that the audit-least path through the first half reaches. Both halves are solved alike, so a segment needs a byte for
each row and a few vectors, not a table of states.

Rows are first reduced to what decides (role, faults, a hash of the text, counts of equal rows) and dealt over ranges of conversation and turn, so one
conversation may span many tasks. Segments that do not hold a whole conversation, two a range at most, send their 4 x 4 cost matrices, which give every
such segment the cost vector behind it and its first state; then all segments are solved at once. Texts are shuffled once, to be written in their new order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import met, saved

REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = ("su", "ua", "au")
INITIALS = {"s": 0, "u": 1, "a": 2}
INF = float("inf")
#: the state after an inserted, or another's, row; what that row's role is; what is still to be inserted at the end, and its cost
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
REST = ((), ("user", "assistant"), ("assistant",), ())
END = tuple(INSERT * len(x) for x in REST)
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def _options(kind: int, state: int) -> list[tuple[str, int, int]]:
    """(edits, state after, cost) for one row, audit-least first: insertions before it, then what happens to it."""
    initial, cut_short = "sua?"[kind >> 1], kind & 1
    found = []
    for inserted in range(3):
        edits, cost = "I" * inserted, INSERT * inserted
        found.append((edits + "D", state, cost + DELETE))
        found.append((edits + "R", NEXT[state], cost + REROLE + CUT_SHORT * cut_short))
        if (initial, state) in KEPT:
            found.append((edits + "K", KEPT[initial, state], cost + CUT_SHORT * cut_short))
        state = NEXT[state]
    return sorted(found)


OPTIONS = [[_options(kind, state) for state in range(4)] for kind in range(8)]
_steps: dict[tuple, tuple] = {}


def _stepped(vector: tuple, kind: int, forward: bool) -> tuple[tuple, float]:
    """(costs of the states one row on, less their least; that least). Vectors whose least is 0 are few, so steps are remembered."""
    found = _steps.get((vector, kind, forward))
    if found is None:
        out = [INF] * 4
        for a in range(4):
            for _, b, cost in OPTIONS[kind][a]:
                if forward:
                    out[b] = min(out[b], vector[a] + cost)
                else:
                    out[a] = min(out[a], vector[b] + cost)
        least = min(out)
        found = _steps[vector, kind, forward] = (tuple(x - least for x in out), least)
    return found


def _through(kinds: bytes, vector: tuple, forward: bool) -> tuple:
    """The cost vector on the other side of rows."""
    total = min(vector)
    vector = tuple(x - total for x in vector)
    for kind in kinds if forward else reversed(kinds):
        vector, more = _stepped(vector, kind, forward)
        total += more
    return tuple(x + total for x in vector)


def _from(state: int) -> tuple:
    return tuple(0 if k == state else INF for k in range(4))


def solved(kinds: bytes, state: int, behind: tuple) -> tuple[list[str], int]:
    """(edits of each row, last state) of the audit-least cheapest path from ``state``; ``behind``: what each last state costs afterwards."""
    if not kinds:
        return [], state
    if len(kinds) == 1:
        fits = OPTIONS[kinds[0]][state]
        best = min(cost + behind[after] for _, after, cost in fits)
        edits, after = next((edits, after) for edits, after, cost in fits if cost + behind[after] == best)
        return [edits], after
    left, right = kinds[: len(kinds) // 2], kinds[len(kinds) // 2 :]
    ahead, back = _through(left, _from(state), True), _through(right, behind, False)
    best = min(a + b for a, b in zip(ahead, back, strict=True))
    crossing = tuple(b if a + b == best else INF for a, b in zip(ahead, back, strict=True))
    first, middle = solved(left, state, crossing)  # no two paths' edits are one the beginning of the other, so the first half decides
    second, last = solved(right, middle, behind)
    return first + second, last


def matrix(kinds: bytes) -> list[tuple]:
    """Costs from each state to each over the rows."""
    return [_through(kinds, _from(state), True) for state in range(4)]


# ---- rows and segments


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) damaged by the remainder of crc32(``conv:turn``) by 20: 0 drops a row, 1 empties its text, 2 removes its signs of an end, 3 repeats it, 4 makes it the user's. A null is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), by.alias("by")).where("by <> 0")
    changed = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    own = own.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("by") == 3, 2).otherwise(1))))
    return own.select("conv", "turn", F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))


def judged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, sha, n, fault): different rows with their number and the first fault of the first one; the others of n are duplicates, or as blank as it."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    own = saved(_named(rows).select("conv", "turn", "role", "sha", fault.alias("fault")).groupBy("conv", "turn", "role", "sha", "fault").agg(F.count("*").alias("n")).withColumn("name", F.xxhash64("conv", "role", "sha")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = saved(own.where(F.col("fault") != BLANK).groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1"))
    marked = met(own, firsts, ["name"], own.count(), "size", "left")
    again = (F.col("fault") != BLANK) & F.col("first").isNotNull() & (place > F.col("first"))
    return marked.select("conv", "turn", "role", "sha", "n", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((range, conv), rows) of sorted rows (range, conv, turn, role, sha, n, fault)."""
    stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, rows in groupby(stream, lambda r: r[:2]):
        yield key, list(rows)


def _kinds(rows: list[tuple]) -> bytes:
    """What decides on rows that need not be deleted."""
    return bytes(2 * INITIALS.get(r[3][:1], 3) + (r[6] == TRUNCATED) for r in rows if r[6] not in (BLANK, DUPLICATE))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, conv, costs) of the first and the last segment of each range."""
    for _, segments in groupby(_segments(batches), lambda s: s[0][0]):
        first = last = None
        for segment in segments:
            first, last = first or segment, segment
        for (range_, conv), rows in [first, last][: 1 + (first is not last)]:
            costs = [float(x) for row in matrix(_kinds(rows)) for x in row]
            yield pa.RecordBatch.from_pylist([{"range": range_, "conv": conv, "costs": costs}], pa.schema([("range", pa.int32()), ("conv", pa.int64()), ("costs", pa.list_(pa.float64()))]))


def _last_states(behind: Broadcast):
    """(range, conv, ends): the last state of a part of a conversation for each first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _segments(batches):
            ends = [solved(_kinds(rows), state, behind.value[key])[1] for state in range(4)]
            yield pa.RecordBatch.from_pylist([{"range": key[0], "conv": key[1], "ends": ends}], pa.schema([("range", pa.int32()), ("conv", pa.int64()), ("ends", pa.list_(pa.int32()))]))

    return run


PLAN = "conv long, turn long, role string, sha binary, n long, fault int, inserted string, edit string, new_role string, appended string"


def _planned(known: Broadcast):
    """A row of the plan for each row: roles inserted before it, its edit, its new role, roles appended at the end of the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PLAN.split(", ")]
        out = []
        for key, rows in _segments(batches):
            start, behind, is_last = known.value.get(key, (0, END, True))
            edits, last = solved(_kinds(rows), start, behind)
            state, each = start, iter(edits)
            for _, conv, turn, role, sha, n, fault in rows:
                inserted, edit, new_role = [], "D", None
                if fault not in (BLANK, DUPLICATE):
                    *before, edit = next(each)
                    for _ in before:
                        inserted.append(ROLE[state])
                        state = NEXT[state]
                    if edit == "R":
                        new_role, state = ROLE[state], NEXT[state]
                    elif edit == "K":
                        new_role, state = role, KEPT[role[0], state]
                out.append([conv, turn, role, sha, n, fault, " ".join(inserted), edit, new_role, ""])
            if is_last and rows:
                out[-1][-1] = " ".join(REST[last])
            if len(out) > 5000:
                yield packed(out, names)
                out = []
        if out:
            yield packed(out, names)

    def packed(out: list[list], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def plan(rows: DataFrame) -> DataFrame:
    """The edits of conversations (conv long, turn, role, text), as a table: a row (PLAN) for each different row, deleted ones included."""
    spark = rows.sparkSession
    order = ["conv", "turn", "role", "sha"]
    ranged = saved(judged(rows).repartitionByRange(*order).select(F.spark_partition_id().alias("range"), *order, "n", "fault"))
    sorted_ = lambda df: df.repartition("range").sortWithinPartitions("range", *order)
    parts: dict[int | None, list] = {}
    for r in sorted_(ranged).mapInArrow(_edges, "range int, conv long, costs array<double>").orderBy("range").collect():  # two a range at most
        parts.setdefault(r.conv, []).append((r.range, [r.costs[k : k + 4] for k in range(0, 16, 4)]))
    behind = {}
    for conv, own in parts.items():
        vector = END
        for range_, costs in reversed(own if len(own) > 1 else []):
            behind[range_, conv] = vector
            vector = tuple(min(a + b for a, b in zip(row, vector, strict=True)) for row in costs)
    known = {}
    if behind:
        keys = spark.createDataFrame(list(behind), "_range int, _conv long")
        open_ = ranged.join(F.broadcast(keys), (F.col("range") == F.col("_range")) & F.col("conv").eqNullSafe(F.col("_conv"))).select(ranged.columns)
        found = sorted_(open_).mapInArrow(_last_states(spark.sparkContext.broadcast(behind)), "range int, conv long, ends array<int>").collect()
        ends = {(r.range, r.conv): r.ends for r in found}
        for conv, own in parts.items():
            state = 0
            for range_, _ in own if len(own) > 1 else []:
                known[range_, conv] = (state, behind[range_, conv], range_ == own[-1][0])
                state = ends[range_, conv][state]
    return saved(sorted_(ranged).mapInArrow(_planned(spark.sparkContext.broadcast(known)), PLAN))


STEPS = "conv long, position long, edit string, times long, fault int, turn long, old_role string, role string, text string"


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps in order from plan rows, each before the texts that its name has."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
    here, position, waits, rest = object(), 0, None, []
    for batch in batches:
        out = []

        def put(edit, times, fault, turn, old_role, role, text, out=out):
            nonlocal position
            out.append((here, position, edit, times, fault, turn, old_role, role, text))
            position += 1

        def close():
            nonlocal rest
            for name in rest:
                put("I", 1, None, None, None, name, "")
            rest = []

        for conv, turn, role, sha, text, n, fault, inserted, edit, new_role, appended in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != here:
                close()
                here, position, waits = conv, 0, None
            if edit is None and sha is not None:
                if waits is not None and (turn, role, sha) == waits[:3]:
                    n, fault, edit, new_role = waits[3:]
                    put(edit, 1, fault, turn, role, new_role, text)
                    if n > 1:
                        put("D", n - 1, DUPLICATE, turn, role, None, None)
                    waits = None
            elif sha is None:
                put("", 0, None, None, None, None, None)  # the conversation itself
            else:
                for name in inserted.split():
                    put("I", 1, None, None, None, name, "")
                rest = appended.split()
                if edit != "D":
                    waits = (turn, role, sha, n, fault, edit, new_role)
                else:
                    put("D", n if fault in (BLANK, DUPLICATE) else 1, fault, turn, role, None, None)
                    if n > 1 and fault not in (BLANK, DUPLICATE):
                        put("D", n - 1, DUPLICATE, turn, role, None, None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in STEPS.split(", ")])
    if rest:
        out = [(here, position + k, "I", 1, None, None, None, name, "") for k, name in enumerate(rest)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in STEPS.split(", ")])


def _dealt(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The plan, the texts, and a row without a hash for each of ``ids``: by conversation, in order, a plan row before the texts of its name."""
    own = plan(rows)
    blank = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("n", "fault", "inserted", "edit", "new_role", "appended")]
    texts = _named(rows).select("conv", "turn", "role", "sha", "text", *blank)
    every = own.withColumn("text", F.lit(None).cast("string")).select(texts.columns).unionByName(texts)
    if ids is not None:
        none = [F.lit(None).cast(every.schema[c].dataType).alias(c) for c in every.columns[1:]]
        every = every.unionByName(ids.select("conv").distinct().select("conv", *none))
    return every.repartition("conv").sortWithinPartitions("conv", "turn", "role", "sha", F.col("edit").isNull())


def steps(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Every edit of conversations (conv, turn, role, text) in order (STEPS): kept (K), given another role (R), inserted (I) and deleted (D) rows with their faults.

    Rows go by turn, nulls first, then by role and the SHA-256 of the text. ``times`` counts equal deletions. A null role or text is one space. A null conv is a
    conversation like any other. With ``ids`` (conv) each of these has a first step without an edit. Rows of a conversation are together and in order.
    """
    return _dealt(rows, ids).mapInArrow(_written, STEPS)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, position, role, text): the repaired conversations, positions from 0."""
    kept = steps(rows).where(F.col("edit").isin("K", "R", "I"))
    return kept.select("conv", "position", "role", "text")


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reports of the steps that are written from dealt rows."""
    return _of_steps(_written(batches))


def _of_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in REPORT.split(", ")]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.string()] * 2, strict=True)], names=names)
    out: list[tuple] = []
    stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for conv, own in groupby(stream, lambda r: r[0]):
        counts, cost, illegal, audit, digest, any_ = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}, 0, 0, [], hashlib.sha256(), False
        turns, low, high, seen_turn, before = 0, None, None, None, None
        for _, _, edit, times, fault, turn, old_role, role, text in own:
            audit.append(edit * times)
            if edit in ("K", "R", "I") and edit:
                digest.update((("\n" if any_ else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                any_ = True
            cost += {"D": DELETE * times, "I": INSERT, "R": REROLE}.get(edit, 0) + CUT_SHORT * (fault == TRUNCATED and edit != "D")
            if not edit or edit == "I":
                continue
            if fault:
                counts[fault] += times
            initial = old_role[:1]
            illegal += times - 1 + (before is not None and before + initial not in LEGAL)
            before = initial
            if turn is not None and turn != seen_turn:
                turns, seen_turn = turns + 1, turn
                low, high = turn if low is None else low, turn
        out.append((conv, high - low + 1 - turns if turns else 0, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, "".join(audit), digest.hexdigest()))
        if len(out) == 5000:
            yield packed(out)
            out = []
    if out:
        yield packed(out)


REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reports(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each of ``ids`` and of the conversations.

    A conversation without rows has zeros, an empty audit and the hash of the empty string. The hash is taken row by row: it needs a conversation's texts in order, so
    they stream through one task, which holds a batch of them.
    """
    return _dealt(rows, ids).mapInArrow(_reports, REPORT)
