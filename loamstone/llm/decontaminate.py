"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage with block-max WAND.

Items are indexed in segments of at most SEGMENT words, in posting lists by term that are sorted by segment. Every document is read as
overlapping passages of 2 * SEGMENT words, so each copied segment lies whole in one passage. A score is divided by the segment's score against
itself: 1 means that every term is there. Each passage is a query. For all passages of a chunk at once, the block maxima of their rare terms (and
one bound for a block's common terms) are added up by block; passages that stay under the threshold in every block are done. The others run
block-max WAND with cursors and a pivot, and all segments at or above the threshold are retrieved. A retrieved item is then verified on the whole document: its
5-word shingles must be there by 0.8 or more, either all of them together or those of the question and those of the answer, with or without the shingles
across the border. A side of fewer than 5 words must be there with all its words in order, within twice as many words; if both are so short, one after the other.

The index is built by Spark and broadcast once; documents are read in one pass and never shuffled. Beyond PART_SEGMENTS segments (some 100 MB) the index goes
out in parts, each with a pass of its own, so that no broadcast grows with the items.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from . import tokens as tk
from .io import saved

SEGMENT, BLOCK, SLAB, PART_SEGMENTS = 48, 4, 1024, 100_000
END = 1 << 62
K1, B = 1.2, 0.75
SHINGLE, OVERLAP, THRESHOLD = 5, 0.8, 0.5
COMMON = 0.03  # of the segments: a term in more is common


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the number of each text's first word."""
    starts, ends, words = tb.word_bounds(raw, offsets, tb.SIGNS)
    return tb.span_hashes(tb.lowered(raw), starts, ends), words


def shingle_hashes(terms: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of ``size`` terms; a shorter sequence is one window."""
    if len(terms) < size:
        size = max(1, len(terms))
    out = np.zeros(len(terms) - size + 1 if len(terms) else 0, np.uint64)
    for k in range(size):
        out = tb.mix(out + terms[k : k + len(out)] * np.uint64(2 * k + 3))
    return out


def in_order(terms: np.ndarray, wanted: np.ndarray) -> bool:
    """Whether all ``wanted`` terms follow each other, with others between them or not, within twice as many terms."""
    first = at = np.flatnonzero(terms == wanted[0])
    for w in wanted[1:]:
        places = np.flatnonzero(terms == w)
        k = np.searchsorted(places, at, "right")  # the earliest place behind keeps the stretch short
        first, at = first[k < len(places)], places[k[k < len(places)]]
    return bool((at - first < 2 * len(wanted)).any())


def question_length(text: str) -> int:
    """Characters of the question: up to the last question mark before other text, else up to the last line or sentence; all without any."""
    cuts = [m.end() for m in re.finditer(r"\?+\s*", text) if m.end() < len(text)] or [m.end() for m in re.finditer(r"\n+|[.!]\s+", text) if text[m.end() :].strip()]
    return cuts[-1] if cuts else len(text)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, entries, lengths, terms, counts = [], [], [], [], []
        for i, j, raw, offsets in tb.pieces(batch.column(1)):
            hashes, words = term_hashes(raw, offsets)
            for k in range(j - i):
                own = hashes[words[k] : words[k + 1]]
                for n, part in enumerate(np.array_split(own, -(-len(own) // SEGMENT)) if len(own) else []):  # of like lengths: no tiny last one
                    t, c = np.unique(part, return_counts=True)
                    items += [batch.column(0)[i + k].as_py()] * len(t)
                    entries += [n] * len(t)
                    lengths += [int(c.sum())] * len(t)
                    terms.append(tb.signed(t))
                    counts.append(c)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(entries, pa.int32()), pa.array(lengths, pa.int32()), pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int32())], names=["item", "entry", "length", "term", "tf"])


class Index:
    """Posting lists of terms over segments: sorted by segment, with the largest impact of each list and of each block of BLOCK segments in it.

    Impacts are divided by each segment's own score. Segments are numbered by the share that common terms have in them, so that
    blocks of like shares have tight bounds.
    """

    def __init__(self, item: np.ndarray, entry: np.ndarray, term: np.ndarray, impact: np.ndarray, texts: dict[int, str]):
        names, segment = np.unique(np.stack([item, entry]), axis=1, return_inverse=True)
        segment, n = segment.ravel(), names.shape[1]
        impact = impact / np.bincount(segment, impact)[segment]
        self.terms, column, df = np.unique(term, return_inverse=True, return_counts=True)
        rare = df <= max(2, COMMON * n)
        seldom = rare[column]
        often = np.bincount(segment[~seldom], impact[~seldom], minlength=n)
        order = np.argsort(often, kind="stable")
        segment = np.argsort(order)[segment]
        self.items = names[0][order]
        at = np.lexsort([segment, column])
        self.segment, self.impact = segment[at].astype(np.int32), impact[at]
        self.first = np.concatenate([[0], np.cumsum(df)])
        self.most = np.maximum.reduceat(self.impact, self.first[:-1]) if len(df) else self.impact
        # block maxima of the rare terms, in slabs of SLAB blocks; the common terms of a block have one bound together
        self.rare = self.terms[rare]
        number, column = np.cumsum(rare) - 1, column[at]
        some = np.flatnonzero(rare[column])
        block = self.segment[some] // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (np.diff(column[some]) != 0) | (np.diff(block) != 0)])) if len(some) else some
        most, row, block = np.maximum.reduceat(self.impact[some], new) if len(new) else self.impact[:0], number[column[some[new]]], block[new]
        blocks = -(-n // BLOCK)
        common = often[order][np.minimum(np.arange(1, blocks + 1) * BLOCK, n) - 1] if n else np.zeros(0)
        self.slabs = []
        for b in range(0, blocks, SLAB):
            own = (block >= b) & (block < b + SLAB)
            self.slabs.append((np.searchsorted(row[own], np.arange(len(self.rare) + 1)), block[own] - b, most[own], common[b : b + SLAB]))
        self.maybe = np.zeros(1 << 20, bool)  # a first look at a term's low bits
        self.maybe[self.rare & np.uint64((1 << 20) - 1)] = True
        self.checks = {i: self._check(text) for i, text in texts.items()}
        self.lists: dict[int, tuple[list[int], list[float], dict[int, float]]] = {}

    @staticmethod
    def _check(text: str) -> tuple[int, np.ndarray, list[np.ndarray]]:
        """The size of the shingles (the item's words if it has fewer), all shingles, and the words of the question and of the answer."""
        n, raw = question_length(text), np.frombuffer(text.encode(), np.uint8)
        terms, _ = term_hashes(raw, np.array([0, len(raw)]))
        head = np.frombuffer(text[:n].encode(), np.uint8)
        asked = len(term_hashes(head, np.array([0, len(head)]))[0])
        return max(1, min(SHINGLE, len(terms))), shingle_hashes(terms), [terms[:asked], terms[asked:]]

    def _hopeful(self, terms: np.ndarray, words: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all passages of a chunk the document, first term and end of those whose block maxima reach the threshold in any block.

        A passage has two steps of SEGMENT terms; the next one begins with its second.
        """
        count = np.maximum(1, -(-np.diff(words) // SEGMENT) - 1)
        first = np.cumsum(count) - count
        hit = np.flatnonzero(self.maybe[terms & np.uint64((1 << 20) - 1)])
        k = np.minimum(np.searchsorted(self.rare, terms[hit]), len(self.rare) - 1)
        good = self.rare[k] == terms[hit] if len(self.rare) else np.zeros(0, bool)
        hit, k = hit[good], k[good]
        doc = np.searchsorted(words, hit, "right") - 1
        step = (hit - words[doc]) // SEGMENT
        own, before = step < count[doc], step > 0
        passage = np.concatenate([(first[doc] + step)[own], (first[doc] + step - 1)[before]])
        passage, k = np.divmod(np.unique(passage * max(1, len(self.rare)) + np.concatenate([k[own], k[before]])), max(1, len(self.rare)))
        n = int(count.sum())
        hopeful = np.zeros(n, bool)
        for start, block, most, common in self.slabs:
            size = start[k + 1] - start[k]
            at = tk.gathered(np.arange(len(block)), start[k], size)
            bound = np.bincount(np.repeat(passage, size) * len(common) + block[at], most[at], n * len(common)).reshape(n, len(common))
            hopeful |= (bound + common >= threshold).any(1)
        found = np.flatnonzero(hopeful)
        doc = np.repeat(np.arange(len(count)), count)[found]
        begin = words[doc] + (found - first[doc]) * SEGMENT
        return doc, begin, np.minimum(begin + 2 * SEGMENT, words[doc + 1])

    def _list(self, t: int) -> tuple[list[int], list[float], dict[int, float]]:
        """Segments, impacts and block maxima of a term."""
        if t not in self.lists:
            a, b = self.first[t], self.first[t + 1]
            blocks: dict[int, float] = {}
            segments, impacts = self.segment[a:b].tolist(), self.impact[a:b].tolist()
            for s, x in zip(segments, impacts, strict=True):
                blocks[s // BLOCK] = max(x, blocks.get(s // BLOCK, 0.0))
            self.lists[t] = segments, impacts, blocks
        return self.lists[t]

    def wand(self, numbers: list[int], threshold: float) -> list[tuple[int, float]]:
        """(segment, score) of all segments that the terms (by number) reach.

        Cursors stand on the posting lists, sorted by segment. The pivot is the first segment at which the lists' maxima could add up to the
        threshold; if the maxima of its block do not, all cursors before it leave the block. Only a pivot on which all of them stand is scored.
        """
        cursors = [[(own := self._list(t))[0][0], 0, float(self.most[t]), *own] for t in numbers]
        out = []
        while cursors:
            cursors.sort(key=itemgetter(0))
            bound, k = 0.0, -1
            while bound < threshold and k + 1 < len(cursors):
                k += 1
                bound += cursors[k][2]
            if bound < threshold:
                break
            pivot = cursors[k][0]
            while k + 1 < len(cursors) and cursors[k + 1][0] == pivot:
                k += 1
            near, block = cursors[: k + 1], pivot // BLOCK
            if sum(c[5].get(block, 0.0) for c in near) < threshold:
                target = (block + 1) * BLOCK
                if k + 1 < len(cursors):
                    target = min(target, cursors[k + 1][0])
            elif near[0][0] < pivot:
                target = pivot
            else:
                score = sum(c[4][c[1]] for c in near)
                if score >= threshold:
                    out.append((pivot, score))
                target = pivot + 1
            for c in near:
                if c[0] < target:
                    c[1] = bisect_left(c[3], target, c[1])
                    c[0] = c[3][c[1]] if c[1] < len(c[3]) else END
            cursors = [c for c in cursors if c[0] != END]
        return out

    def retrieve(self, terms: np.ndarray, words: np.ndarray, threshold: float) -> set[tuple[int, int, float]]:
        """(document, item, best score) of all segments that a passage reaches. terms, words: of a chunk of documents."""
        best: dict[tuple[int, int], float] = {}
        threshold -= 1e-9
        for doc, a, b in zip(*(x.tolist() for x in self._hopeful(terms, words, threshold)), strict=True):
            own = np.unique(terms[a:b])
            at = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
            for segment, score in self.wand(at[self.terms[at] == own].tolist(), threshold):
                key = (doc, int(self.items[segment]))
                best[key] = max(best.get(key, 0.0), score)
        return {(d, i, x) for (d, i), x in best.items()}

    def leaks(self, raw: np.ndarray, offsets: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(document, item, score, question overlap, answer overlap) that are retrieved and verified, as a whole or by both sides."""
        terms, words = term_hashes(raw, offsets)
        out = []
        shingles: dict[tuple[int, int], np.ndarray] = {}
        for doc, item, score in sorted(self.retrieve(terms, words, threshold)):
            size, every, sides = self.checks[item]
            own = terms[words[doc] : words[doc + 1]]
            if (doc, size) not in shingles:
                shingles[doc, size] = np.sort(shingle_hashes(own, size))
            there = shingles[doc, size]
            share = lambda x: float((there[np.minimum(np.searchsorted(there, x), len(there) - 1)] == x).mean())  # noqa: B023, E731
            whole = share(every)
            if not all(len(x) for x in sides):  # one side only
                asked, answered = (whole if len(x) else 1.0 for x in sides)
            else:
                if max(map(len, sides)) < SHINGLE:
                    asked = answered = float(in_order(own, np.concatenate(sides)))
                else:
                    asked, answered = (share(shingle_hashes(x)) if len(x) >= SHINGLE else float(in_order(own, x)) for x in sides)
                n = len(sides[0])  # shingles across the border may count for both sides
                asked, answered = max(asked, share(every[:n])), max(answered, share(every[max(0, n - size + 1) :]))
            if max(whole, min(asked, answered)) >= overlap:
                out.append((doc, item, min(1.0, score), asked, answered))
        return out


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index, in more than one part only beyond PART_SEGMENTS segments; statistics are over all items.

    Null ids and texts without a word are skipped; texts that repeat an id are joined by a line break.
    """
    items = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("item")).agg(F.concat_ws("\n", F.sort_array(F.collect_set(text_col))).alias("text"))
    items = saved(items)
    rows = saved(items.mapInArrow(_entries, "item long, entry int, length int, term long, tf int"))
    sizes = rows.select("item", "entry", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    if not sizes.n:
        return
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (sizes.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / sizes.mean))
    rows = saved(rows.join(df, "term").select("item", "entry", "term", impact.alias("impact")))
    parts = -(-sizes.n // PART_SEGMENTS)
    part = F.pmod(F.xxhash64("item"), F.lit(parts))
    for k in range(parts):  # each part is of bounded size
        own, texts = rows.where(part == k).toArrow(), items.where(part == k).toArrow()
        columns = (own.column(c).to_numpy() for c in ("item", "entry", "term", "impact"))
        item, entry, term, weight = columns
        if len(item):
            yield Index(item, entry.astype(np.int64), term.view(np.uint64), weight, dict(zip(texts.column("item").to_pylist(), texts.column("text").to_pylist(), strict=True)))


def _found(index: Broadcast[Index], threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in tb.pieces(batch.column(1)):
                found = index.value.leaks(raw, offsets, threshold, overlap)
                columns = list(zip(*found, strict=True)) or [[]] * 5
                ids = batch.column(0).slice(i, j - i).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[2:]]], names=["id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap), a row for each document and test item verified in it.

    The overlaps are shares of a side's shingles, with or without those across the border, whichever is more; one may be low if the item as a whole is there.
    A null or empty text holds no item. Rows that repeat an id are searched each. Other columns are ignored. Without items nothing is found.
    """
    schema = "id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = texts.sparkSession.createDataFrame([], schema)
    for index in indexes(items):
        out = out.unionByName(texts.mapInArrow(_found(texts.sparkSession.sparkContext.broadcast(index), threshold, overlap), schema))
    return out.withColumnRenamed("id", id_col)


def _clean(index: Broadcast[Index], at: int, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in tb.pieces(batch.column(at)):
                good = np.ones(j - i, bool)
                good[[x[0] for x in index.value.leaks(raw, offsets, threshold, overlap)]] = False
                yield batch.slice(i, j - i).filter(pa.array(good))

    return run


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text no test item is verified."""
    for index in indexes(items):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_col), threshold, overlap), docs.schema)
    return docs
