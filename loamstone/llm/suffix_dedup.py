"""Repeated-substring removal by bucket-pointer refinement of suffixes.

Suffixes are dealt to buckets by their first 8 bytes; a bucket is refined by the identifiers of the buckets at later offsets,
and the refined identifiers are used again for the next, doubled depth: 8, 16, ... up to half a window, then a whole window.
An identifier is a 64-bit mix of the two identifiers below it, so tasks that never meet name the same bucket alike.

Refining all suffixes of a corpus at once would shuffle a row per byte. Here buckets are dropped as soon as they are known to hold
one suffix, and only one suffix in about a quarter window stands for its neighbours:

1. In each window the suffix whose half-window bucket has the least identifier is its anchor (equal windows have equal anchors).
   Anchors are counted by bucket; a bucket with one anchor settles all of its windows.
2. A bucket of anchors that all have the same surroundings settles all of its windows, too: they repeat.
3. In the buckets left, one anchor for each surrounding is refined to whole windows, BLOCK neighbours at a time: if the string that
   spans all of them repeats, they all do; if the string that they share does not, none does. Only the windows of the
   blocks between are counted one by one.

A text is a sequence of bytes, or of words: word hashes take the place of bytes, and depths, windows and positions count words.

Counts are pre-aggregated by key, so a passage that a third of all documents share costs a row per task; no group is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import textbytes as tb
from .io import free_name, released, saved

WINDOW, BLOCK = 400, 16
#: The bits of an identifier that give way to positions in the search for anchors: as many in every chunk (a text has under 2**31 bytes), or equal windows of two chunks might choose differently.
LOW = np.uint64((1 << 31) - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a bucket refined from those at two offsets."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def half_buckets(raw: np.ndarray, half: int) -> np.ndarray:
    """The bucket identifier at depth ``half`` (8 at least) of each suffix that long, of bytes or of word hashes; borders between texts are the caller's."""
    x, depth = raw.astype(np.uint64), 1
    if raw.dtype == np.uint8:
        for k in (1, 2, 4):
            x = x[:-k] | (x[k:] << np.uint64(8 * k))
        depth = 8
    while depth < half:
        by = min(depth, half - depth)
        x = _pair(x[:-by], x[by:])
        depth += by
    return x


class Windows:
    """The buckets of a chunk of texts, and the anchor of each window that lies within a text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int):
        self.window, self.gap = window, window // 2
        self.half = window - self.gap  # the larger part of an odd window, so that two buckets ``gap`` apart leave nothing out
        size = np.diff(offsets)
        n = np.maximum(size - window + 1, 0)
        self.doc = np.repeat(np.arange(len(size)), n)  # of each window
        self.at = np.arange(n.sum()) + np.repeat(offsets[:-1] - (np.cumsum(n) - n), n)
        self.offsets = offsets
        if not len(self.at):
            self.anchor = self.at
            return
        self.id = half_buckets(raw, self.half)
        least = (self.id & ~LOW) | np.arange(len(self.id), dtype=np.uint64)
        width, have = self.gap + 1, 1
        while have < width:
            by = min(have, width - have)
            least = np.minimum(least[:-by], least[by:])
            have += by
        self.anchor = (least[self.at] & LOW).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Document, position, bytes of surroundings on the left and right, bucket and identifier of surroundings, of each anchor."""
        new = np.concatenate([[True], self.anchor[1:] != self.anchor[:-1]]) if len(self.anchor) else np.zeros(0, bool)
        at, doc = self.anchor[new], self.doc[new]
        left = np.minimum(self.gap, at - self.offsets[doc])
        right = np.minimum(self.gap, self.offsets[doc + 1] - at - self.half)
        around = _pair(_pair(self.id[at - left], self.id[at]), self.id[at + right]) if len(at) else np.zeros(0, np.uint64)
        around = _pair(around, (left * (self.gap + 1) + right).astype(np.uint64))
        return doc, at - self.offsets[doc], left, right, self.id[at] if len(at) else around, around

    def _mine(self, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows (by number) whose anchors are given, and for each the number of its anchor in the sorted ones."""
        keys = np.unique(self.offsets[doc] + at)
        k = np.searchsorted(keys, self.anchor)
        some = np.flatnonzero(keys[np.minimum(k, len(keys) - 1)] == self.anchor) if len(keys) else np.zeros(0, np.int64)
        return some, k[some]

    def blocks(self, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, anchor, number, first byte and end, identifiers of the spanning and of the shared string, of each block of windows of the given anchors.

        Block k of an anchor has the windows that start BLOCK * k and up to BLOCK - 1 bytes more before it.
        """
        some, _ = self._mine(doc, at)
        d, anchor = self.doc[some], self.anchor[some]
        number = (anchor - self.at[some]) // BLOCK
        key = np.unique(np.stack([d, anchor, number]), axis=1) if len(d) else np.zeros((3, 0), np.int64)
        d, anchor, number = key
        last = np.minimum(anchor - BLOCK * number, self.offsets[d + 1] - self.window)
        first = np.maximum(np.maximum(anchor - BLOCK * number - BLOCK + 1, anchor - self.gap), self.offsets[d])
        if not len(d):
            return d, anchor, number, d, d, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        # a text's end may cut the block short, and with it the spanning string; the shared one lies in any window of the block
        salt, core = _pair(self.id[anchor], number.astype(np.uint64)), anchor - BLOCK * number
        whole = _pair(_pair(self.id[first], self.id[first + self.gap]), _pair(self.id[last], self.id[last + self.gap]))
        whole = _pair(_pair(salt, (last - first).astype(np.uint64)), whole)
        shared = _pair(~salt, _pair(self.id[core], self.id[core + self.gap - BLOCK + 1]))
        return d, anchor - self.offsets[d], number, first - self.offsets[d], last + self.window - self.offsets[d], whole, shared

    def of_blocks(self, doc: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, position and whole-window bucket of the windows of the given blocks."""
        some, _ = self._mine(doc, at)
        code = lambda a, n: a * (self.gap // BLOCK + 1) + n
        some = some[np.isin(code(self.anchor[some], (self.anchor[some] - self.at[some]) // BLOCK), code(self.offsets[doc] + at, number))]
        p, d = self.at[some], self.doc[some]
        bucket = _pair(self.id[p], self.id[p + self.gap]) if len(p) else np.zeros(0, np.uint64)
        return d, p - self.offsets[d], bucket


def _sequences(column: pa.Array, words: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes or word hashes, offsets) for each chunk of a column."""
    for i, j, raw, offsets in tb.pieces(column):
        if words:
            starts, ends, first = tb.word_bounds(raw, offsets)
            raw, offsets = tb.span_hashes(raw, starts, ends), first
        yield i, j, raw, offsets


def _anchors(window: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in _sequences(batch.column("text"), words):
                doc, at, left, right, bucket, around = Windows(raw, offsets, window).anchors()
                own = batch.slice(i, j - i).select(["id", "h"]).take(pa.array(doc, pa.int64()))
                ints = [pa.array(x, pa.int32()) for x in (at, left, right)]
                yield pa.RecordBatch.from_arrays([*own.columns, *ints, pa.array(tb.signed(bucket)), pa.array(tb.signed(around))], names=["id", "h", "at", "l", "r", "a", "c"])

    return run


def _blocks(window: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in _sequences(batch.column("text"), words):
                lists = batch.column("ats").slice(i, j - i)
                doc = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                doc, at, number, first, end, whole, shared = Windows(raw, offsets, window).blocks(doc, lists.flatten().to_numpy().astype(np.int64))
                own = batch.slice(i, j - i).select(["id", "h"]).take(pa.array(doc, pa.int64()))
                rest = [*(pa.array(x, pa.int32()) for x in (at, number, first, end)), pa.array(tb.signed(whole)), pa.array(tb.signed(shared))]
                yield pa.RecordBatch.from_arrays([*own.columns, *rest], names=["id", "h", "at", "k", "s", "e", "whole", "shared"])

    return run


def _refined(window: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in _sequences(batch.column("text"), words):
                ats, ks = (batch.column(c).slice(i, j - i) for c in ("ats", "ks"))
                doc = np.repeat(np.arange(j - i), ats.value_lengths().to_numpy())
                doc, at, bucket = Windows(raw, offsets, window).of_blocks(doc, ats.flatten().to_numpy().astype(np.int64), ks.flatten().to_numpy().astype(np.int64))
                own = batch.slice(i, j - i).select(["id", "h"]).take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(at, pa.int32()), pa.array(tb.signed(bucket))], names=["id", "h", "at", "w"])

    return run


def _with_texts(texts: DataFrame, wanted: DataFrame, *lists: str) -> DataFrame:
    t, c = texts.alias("t"), wanted.alias("c")
    return t.join(c, F.col("t.id").eqNullSafe(F.col("c.id")) & (F.col("t.h") == F.col("c.h"))).select("t.id", "t.h", "t.text", *[f"c.{x}" for x in lists])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, words: bool = False) -> DataFrame:
    """(id, h, starts, ends) for each text that holds a string of ``window`` bytes which also starts anywhere else.

    h is xxhash64 of the text (null: empty); it tells texts that share an id apart. starts and ends are parallel lists of byte
    spans, unordered and possibly overlapping, that cover exactly the bytes of such strings. With ``words`` a window is so many
    words (runs without white space, as they are written) and the spans count words.
    """
    half = window - window // 2
    if window < 32:
        raise ValueError("window must be 32 bytes or words at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).where(F.octet_length("text") >= (2 * window - 1 if words else window))
    anchors = saved(texts.mapInArrow(_anchors(window, words), "id long, h long, at int, l int, r int, a long, c long"))
    buckets = anchors.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1").select("a", (F.col("lo") < F.col("hi")).alias("mixed"))
    # counts are tables of their own, so that the joins back have plain exchanges on both sides and a hot bucket can be split
    buckets = saved(buckets)
    repeated = saved(anchors.join(buckets, "a"))
    released(anchors, buckets)
    span = ["id", "h", (F.col("at") - F.col("l")).alias("s"), (F.col("at") + half + F.col("r")).alias("e")]
    one = repeated.where("not mixed").select(*span)
    mixed = repeated.where("mixed").drop("mixed")
    around = saved(mixed.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "at")).alias("first")))
    many = mixed.join(around.where("n > 1").select("a", "c"), ["a", "c"], "left_semi").select(*span)
    chosen = around.select("first.*").groupBy("id", "h").agg(F.collect_list("at").alias("ats"))
    # the texts that are looked at again are a part of all; they are dealt once
    near = saved(_with_texts(texts, chosen, "ats"))
    blocks = saved(near.mapInArrow(_blocks(window, words), "id long, h long, at int, k int, s int, e int, whole long, shared long"))
    twice = saved(blocks.select(F.explode(F.array("whole", "shared")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w"))
    once = lambda c: twice.select(F.col("w").alias(c), F.lit(True).alias(f"{c}_again"))
    judged = saved(blocks.join(once("shared"), "shared").join(once("whole"), "whole", "left").drop("shared_again"))
    released(blocks, twice)
    live, doubt = judged.where("whole_again"), judged.where("whole_again is null")
    # a block in doubt may share windows with one that is settled: one of each such kind is refined with it
    # (the least block of each kind is chosen before the join, so a passage of many documents is not dealt by its key)
    kinds = saved(live.groupBy("shared", "whole").agg(F.min(F.struct("id", "h", "at", "k")).alias("b")))
    partners = kinds.join(doubt.select("shared").distinct(), "shared", "left_semi").groupBy("whole").agg(F.min("b").alias("b")).select("b.*")
    doubt = doubt.select("id", "h", "at", "k").unionByName(partners).groupBy("id", "h").agg(F.collect_list("at").alias("ats"), F.collect_list("k").alias("ks"))
    windows = saved(_with_texts(near, doubt, "ats", "ks").mapInArrow(_refined(window, words), "id long, h long, at int, w long"))
    released(near, kinds)
    again = saved(windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w"))
    rest = windows.join(again, "w", "left_semi").select("id", "h", F.col("at").alias("s"), (F.col("at") + window).alias("e"))
    spans = one.unionByName(many).unionByName(live.select("id", "h", "s", "e")).unionByName(rest)
    # a set: equal rows have equal spans, and there may be very many of them
    found = saved(spans.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e")).alias("x")).select("id", "h", F.col("x.s").alias("starts"), F.col("x.e").alias("ends")))
    released(repeated, around, judged, windows, again)
    return found


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with the lists of ``repeated_spans`` as _starts and _ends (null where nothing repeats; more underscores if columns have these names).

    With ``words`` there are also _first and _last: the spans, in words, of strings of so many words that repeat. Then all four are null or none is.
    """
    own, spans = docs.alias("own"), repeated_spans(docs, id_col, text_col, window)
    lists = ["starts", "ends"]
    if words is not None:
        none = F.array().cast("array<int>")
        both = spans.withColumns({"first": none, "last": none}).unionByName(
            repeated_spans(docs, id_col, text_col, words, words=True).select("id", "h", none.alias("starts"), none.alias("ends"), F.col("starts").alias("first"), F.col("ends").alias("last"))
        )
        lists += ["first", "last"]
        spans = both.groupBy("id", "h").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])  # two rows at most
    spans = spans.alias("spans")
    same = F.col(f"own.{id_col}").cast("long").eqNullSafe(F.col("spans.id")) & (F.xxhash64(F.coalesce(F.col(f"own.{text_col}"), F.lit(""))) == F.col("spans.h"))
    return own.join(spans, same, "left").select("own.*", *[F.col(f"spans.{c}").alias(free_name(docs, f"_{c}")) for c in lists])


def merged(starts: np.ndarray | None, ends: np.ndarray | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal runs, in order."""
    if starts is None or not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return list(zip(s[new].tolist(), e[np.append(new[1:], True)].tolist(), strict=True))


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for s, e in runs:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def _cut(data: bytes, starts: np.ndarray | None, ends: np.ndarray | None, first: np.ndarray | None, last: np.ndarray | None) -> str:
    """A text without spans of bytes and of words."""
    grown = []
    for a, b in merged(starts, ends):  # a character goes with any of its bytes
        while a > 0 and a < len(data) and data[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        grown.append((a, b))
    if first is not None and len(first):
        begin, end, _ = tb.word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        grown += [(int(begin[a]), int(end[b - 1])) for a, b in merged(first, last)]
    return _without(data, merged([a for a, _ in grown], [b for _, b in grown])).decode()


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        passages = batch.shape[1] > 4
        for i, text, starts, ends, *words in batch.itertuples(index=False):
            data, runs = (text or "").encode(), merged(starts, ends)
            row = (i, len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(_without(data, runs)).hexdigest())
            if passages:
                row += (sum(b - a for a, b in merged(*words)), text if starts is None else _cut(data, starts, ends, *words))
            out.append(row)
        frame = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "text"][: 7 if passages else 5])
        frame["id"] = frame["id"].astype("Int64")
        yield frame


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, words: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of ``docs``.

    Texts are UTF-8 bytes, a null text is empty; every byte of a ``window``-byte string that also starts elsewhere, in the same
    text or another, is removed, judged on the input. Texts shorter than the window keep all. Rows that repeat an id and a text
    count as two texts. Null ids are allowed, other columns are ignored.

    With ``words`` two more columns follow: n_passage_words, the words in strings of so many words that repeat, however few bytes
    they have, and text, what ``without_repeats`` leaves when it cuts both kinds. The columns before them stay the same.
    """
    found = with_spans(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", window, words)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passage_words long, text string" * (words is not None)
    return found.mapInPandas(_digest, schema).withColumnRenamed("id", id_col)


@F.pandas_udf(StringType())
def _kept_text(text: pd.Series, starts: pd.Series, ends: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([_cut(t.encode(), *spans) for t, *spans in zip(text, starts, ends, first, last, strict=True)])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, words: int | None = None) -> DataFrame:
    """``docs`` with repeated strings cut out of the texts; other columns as they were, texts without repeats untouched (null stays null).

    Cut are strings of ``window`` bytes and, with ``words``, also strings of so many words, however few bytes they have.
    """
    found = with_spans(docs, id_col, text_col, window, words)
    spans = [c for c in found.columns if c not in docs.columns]
    none = F.array().cast("array<int>")
    cut = _kept_text(F.coalesce(F.col(text_col), F.lit("")), *[F.col(c) for c in spans], *[none] * (4 - len(spans)))
    return found.withColumn(text_col, F.when(F.col(spans[0]).isNull(), F.col(text_col)).otherwise(cut)).drop(*spans)
