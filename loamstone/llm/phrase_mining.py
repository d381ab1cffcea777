"""Phrase collocations by weighted acyclic automata.

Every word of a piece starts a path: its language, itself and up to three words after it. A task sorts the paths of a shard of texts and builds from them, level
by level, a minimal acyclic automaton: equal states (the same arcs to the same states, down to the weights of whole paths) are kept once. It is cut at split
points of the order of paths, so that each piece is an automaton of its own. Where the pieces of one range of paths meet, they are united and weights of equal
paths are summed. The number of a phrase's occurrences is then the sum over the range of paths that it begins, so one automaton counts phrases of one to four
words. Only frequent phrases leave a task, and what a border of ranges cuts in two is summed again. The parts of a phrase are looked up among the frequent
phrases: a part is at least as frequent as the whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .io import saved

LONGEST, LEAST, TOP, COVERED = 4, 30, 2000, 80
#: bytes of the texts of a shard, and of those whose paths make a range; a range is united in PARTS, one after another
SHARD_BYTES, RANGE_BYTES, PARTS = 4 << 20, 32 << 20, 8
#: split points come from about this many documents, one path for each SAMPLE_WORDS words; they decide balance only
SAMPLE_DOCS, SAMPLE_WORDS = 20_000, 200
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
BETWEEN = BREAKS.copy()
BETWEEN[list(b" \t")] = True


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words as bytes, the number of each word's text, the number of its piece)."""
    raw = tb.lowered(raw)
    starts, ends, _ = tb.word_bounds(raw, offsets, BETWEEN)
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(BREAKS[raw], dtype=np.int32)[starts] + text if len(starts) else starts  # both only grow, so the sum changes when one does
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw[~BETWEEN[raw]]))])
    return words, text, piece


def _numbered(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(different values in order, the number of each value among them)."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def _keys(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """A path as two numbers; symbols are less than ``base``."""
    return (columns[0].astype(np.int64) * base + columns[1]) * base + columns[2], columns[3].astype(np.int64) * base + columns[4]


def _summed(columns: list[np.ndarray], weights: np.ndarray | None, base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different paths in order, and the sums of their weights (1 each by default)."""
    high, low = _keys(columns, base)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(order))) if weights is None else np.add.reduceat(weights[order], at) if len(at) else weights
    return [c[order[at]] for c in columns], counts.astype(np.int64)


def shard_paths(langs: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray]:
    """(languages, words, five columns of symbols, weights) of the sorted paths of some texts; a symbol is a number among the languages or, from 1, the words; 0 is the end of a piece."""
    words, text, piece = _words(raw, offsets)
    names, own = _numbered(words)
    tongues, spoken = _numbered(langs)
    own, columns = own.astype(np.int32), [spoken[text].astype(np.int32)]
    for k in range(LONGEST):
        symbol = np.zeros(len(own), np.int32)
        symbol[: len(own) - k] = np.where(piece[k:] == piece[: len(own) - k], own[k:] + 1, 0)
        columns.append(symbol)
    return tongues, names, *_summed(columns, None, len(names) + 2)


# ---- automata as arrays


def _framed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers that are not negative, each in the least width that holds it."""
    small = [a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for a in arrays]
    head = np.array([x for a in small for x in (a.dtype.itemsize, len(a))], "<i8")
    return b"".join([len(small).to_bytes(2, "little"), head.tobytes(), *(a.tobytes() for a in small)])


def _unframed(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:2], "little")
    head, at, out = np.frombuffer(data, "<i8", 2 * n, 2).tolist(), 2 + 16 * n, []
    for width, size in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(data, f"<u{width}", size, at).astype(np.int64))
        at += width * size
    return out


def automaton(columns: list[np.ndarray], weights: np.ndarray) -> bytes:
    """The minimal acyclic automaton of different sorted paths: for each level, from the last, its different states as (number of arcs, labels, states that arcs lead to).

    Equal states are told by 64-bit hashes of their arcs and numbered as they first come, so most arcs lead to the state after the one before; the
    states after the last level are the weights themselves.
    """
    new, levels = np.zeros(len(weights), bool), []
    new[:1] = True
    opens = []
    for c in columns:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        opens.append(np.flatnonzero(new))
    target = weights
    for depth in range(len(columns) - 1, -1, -1):
        label = columns[depth][opens[depth]]
        first = np.searchsorted(opens[depth], opens[depth - 1]) if depth else np.zeros(1, np.int64)
        arcs = np.diff(np.append(first, len(label)))
        sign = tb.mix(tb.mix(label.astype(np.uint64) + tb.BASE) ^ (target.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        _, chosen, state = np.unique(np.add.reduceat(sign, first), return_index=True, return_inverse=True)
        order = np.argsort(chosen)
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        chosen = chosen[order]
        rows = _runs(first[chosen], arcs[chosen])
        levels += [arcs[chosen], label[rows], target[rows] if depth == len(columns) - 1 else _steps(target[rows])]
        target = number[state]
    return zstandard.compress(_framed(levels))


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences to the number before, less one, as numbers that are not negative."""
    d = np.diff(x, prepend=-1) - 1
    return np.where(d >= 0, 2 * d, -2 * d - 1)


def _walked(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(steps % 2 == 0, steps // 2, -(steps + 1) // 2) + 1) - 1


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one after another."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def paths(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted paths and weights of an automaton."""
    levels = _unframed(zstandard.decompress(data))
    columns, state = [], np.zeros(1, np.int64)
    for k in range(len(levels) - 3, -1, -3):
        arcs, label, target = levels[k : k + 3]
        target = _walked(target) if k else target
        first = np.cumsum(arcs) - arcs
        size = arcs[state]
        rows = _runs(first[state], size)
        columns = [np.repeat(c, size) for c in columns] + [label[rows]]
        state = target[rows]
    return columns, state


def _joined(words: pa.Array) -> bytes:
    spaced = pc.binary_join_element_wise(words, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    return zstandard.compress(tb.flat(spaced)[0].tobytes()[:-1])


def _split(data: bytes) -> pa.Array:
    raw = np.frombuffer(zstandard.decompress(data) + b" ", np.uint8)
    ends = np.flatnonzero(raw == 32)
    at = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw[raw != 32]))])


def _place(split: tuple, tongues: list, names: list) -> tuple[int, ...]:
    """The first path, in a shard's symbols, that is not before ``split``."""
    out = []
    for k, value in enumerate(split):
        if k and value == b"":
            out.append(0)
            continue
        own = names if k else tongues
        at = bisect_left(own, value)
        out.append(at + (k > 0))
        if at == len(own) or own[at] != value:
            break
    return tuple(out) + (0,) * (LONGEST + 1 - len(out))


def _cut(splits: Broadcast, shard_bytes: int):
    """(range, langs, words, automata) of the shards of a task, a row for each range that a shard has paths in, with an automaton for each part of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.flat(batch.column("text"))
            for i, j in tb.chunks(offsets, shard_bytes):
                yield shard(batch.column("lang").slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def shard(langs: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        tongues, names, columns, weights = shard_paths(langs.cast(pa.large_binary()), raw, offsets)
        base, rows = len(names) + 2, []
        high, low = _keys(columns, base)
        as_list = tongues.to_pylist(), names.to_pylist()
        at = [0]
        for split in splits.value:
            a, b, c, d, e = _place(split, *as_list)
            left, right = np.searchsorted(high, (a * base + b) * base + c, "left"), np.searchsorted(high, (a * base + b) * base + c, "right")
            at.append(int(left + np.searchsorted(low[left:right], d * base + e)))
        at.append(len(weights))
        for k in range(0, len(at) - 1, PARTS):
            own = at[k : k + PARTS + 1]
            if own[0] < own[-1]:
                part = [c[own[0] : own[-1]] for c in columns]
                used = np.unique(np.concatenate(part[1:]))
                used = used[used > 0]
                spoken = np.unique(part[0])
                part = [np.searchsorted(spoken, part[0]), *(np.where(c > 0, np.searchsorted(used, c) + 1, 0) for c in part[1:])]
                each = [automaton([c[a - own[0] : b - own[0]] for c in part], weights[a:b]) if a < b else b"" for a, b in zip(own, own[1:])]
                rows.append((k // PARTS, tongues.take(pa.array(spoken)).to_pylist(), _joined(names.take(pa.array(used - 1))), each))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.binary())))], names=["range", "langs", "words", "automata"])

    return run


def _united(least: int):
    """(lang, n, phrase, f, whole) of the phrases of the range of a task: the frequent ones, and, not whole, those that a border may cut; n is 0 for a language itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [batch for batch in batches if batch.num_rows]  # the pieces of one range
        if table:
            yield from united(pa.Table.from_batches(table)).to_batches()

    def united(table: pa.Table) -> pa.Table:
        langs, words = table.column("langs").combine_chunks(), [_split(x) for x in table.column("words").to_pylist()]
        tongues, spoken = _numbered(langs.flatten().cast(pa.large_binary()))
        names, own = _numbered(pa.concat_arrays(words))
        lang_at, word_at = (np.concatenate([[0], np.cumsum(x)]) for x in (langs.value_lengths().to_numpy(), [len(x) for x in words]))
        out = []
        for part in zip(*table.column("automata").to_pylist()):
            columns, weights = [[] for _ in range(LONGEST + 1)], []
            for k, data in enumerate(part):
                if data:
                    own_paths, w = paths(data)
                    weights.append(w)
                    columns[0].append(spoken[lang_at[k] + own_paths[0]].astype(np.int32))
                    symbols = np.concatenate([[0], own[word_at[k] : word_at[k + 1]] + 1]).astype(np.int32)
                    for c, p in zip(columns[1:], own_paths[1:], strict=True):
                        c.append(symbols[p])
            if weights:
                out += counted(*_summed([np.concatenate(c) for c in columns], np.concatenate(weights), len(names) + 2), tongues, names)
        return pa.concat_tables(out)

    def counted(columns: list[np.ndarray], weights: np.ndarray, tongues: pa.Array, names: pa.Array) -> list[pa.Table]:
        new, out = np.zeros(len(weights), bool), []
        new[0] = True
        for n, c in enumerate(columns):
            new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            f = np.add.reduceat(weights, at)
            cut = np.zeros(len(at), bool)
            cut[[0, -1]] = True
            keep = ((f >= least) | cut | (n == 0)) & ((c[at] > 0) | (n == 0))
            at, f, cut = at[keep], f[keep], cut[keep]
            parts = [names.take(pa.array(x[at] - 1)) for x in columns[1 : n + 1]]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n else pa.array([b""] * len(at), pa.large_binary())
            out.append(pa.table({"lang": tongues.take(pa.array(columns[0][at])).cast(pa.string()), "n": pa.array(np.full(len(at), n, np.int32)), "phrase": phrase.cast(pa.string()), "f": pa.array(f), "whole": pa.array(~cut & (n > 0))}))
        return out

    return run


def _sampled(one_in: int):
    """(path, bytes): one path in ``one_in`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for batch in batches:
            raw, offsets = tb.flat(batch.column("text"))
            for i, j in tb.chunks(offsets, SHARD_BYTES):
                words, text, piece = _words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.flatnonzero(rng.integers(0, one_in, len(text)) == 0)
                found = []
                for p in at.tolist():
                    own = [x.as_py() for k, x in enumerate(words[p : p + LONGEST]) if piece[p + k] == piece[p]]
                    found.append([batch.column("lang")[i + int(text[p])].as_py().encode(), *own, *[b""] * (LONGEST - len(own))])
                yield pa.RecordBatch.from_arrays([pa.array([*found, None], pa.list_(pa.binary())), pa.array([0] * len(found) + [int(offsets[j] - offsets[i])], pa.int64())], names=["path", "bytes"])

    return run


def frequencies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, n, phrase, f), as a table: all phrases of 1 to 4 words inside pieces that occur ``least`` times or more in their language; n = 0 counts the words of a language."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    sample = own.sample(share, 7).mapInArrow(_sampled(SAMPLE_WORDS), "path array<binary>, bytes long").toArrow()  # of bounded size
    found = sorted(tuple(x) for x in sample.column("path").to_pylist() if x)
    size = sum(sample.column("bytes").to_pylist()) / share
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / RANGE_BYTES))
    splits = [found[len(found) * k // (ranges * PARTS)] for k in range(1, ranges * PARTS)] if found else []  # equal ones leave parts empty
    cut = own.mapInArrow(_cut(spark.sparkContext.broadcast(splits), SHARD_BYTES), "range int, langs array<binary>, words binary, automata array<binary>")
    some = saved(cut.repartitionById(ranges, "range").mapInArrow(_united(least), "lang string, n int, phrase string, f long, whole boolean"))
    summed = some.where("not whole").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("n") == 0))
    return saved(some.where("whole").select("lang", "n", "phrase", "f").unionByName(summed))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int | None = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to 4 words by the score of their weakest cut, the ``top`` best of each language (all with None).

    A phrase occurs ``a`` times; a cut gives floor(2,000,000 a / (l + r)) from the occurrences of its parts; of equal cuts the first counts. Phrases that a longer frequent one
    holds, with ``covered`` percent of their occurrences or more, are left out. Ties: a descending, then the phrase by its bytes. A null text is empty, a null language is
    ``und``. Repeated rows count as often as they come; ids and other columns are ignored. An empty table gives no rows. Numbers are exact up to 2**63 occurrences.
    """
    all_ = frequencies(docs, text_col, lang_col, least)
    known = all_.where("n > 0").select("lang", F.col("phrase").alias("part"), F.col("f"))
    long = all_.where("n > 1").select("lang", "phrase", F.col("n").alias("words"), F.col("f").alias("a"))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    left, right = known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("top", F.lit(2_000_000).cast("decimal(7,0)") * wide("a")).withColumn("under", wide("l") + wide("r"))
    scored = scored.withColumn("score", F.expr("top div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best")).select("lang", "phrase", "best.*")
    spans = F.expr("filter(flatten(transform(sequence(0, words - 2), i -> transform(sequence(2, words - 1), s -> struct(i + 1 as at, s as size)))), x -> x.at + x.size - 1 <= words)")
    inside = long.where("words > 2").withColumn("span", F.explode(spans)).withColumn("inner", F.expr("array_join(slice(split(phrase, ' '), span.at, span.size), ' ')"))
    outer = inside.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("outer"))
    hidden = 100 * wide("outer") >= covered * wide("a")
    free = best.join(outer, ["lang", "phrase"], "left").where(F.col("outer").isNull() | ~hidden)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    totals = all_.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
