"""License texts by patience alignment.

Words that occur once in a text's region and once in a template are anchors; the longest run of anchors that increases in both is kept, and
the gaps between neighbours are aligned the same way. Coverage is the share of the template's words that are aligned.
A region is a stretch of a text whose words could cover a template: windows of the widest width that hold enough of its words, merged
while they overlap. In a region each place that may begin a copy is aligned within a window little longer than the template, and what is left within wider ones (WIDTHS). Every text is read whole; texts without such a region are never aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .decontaminate import term_hashes

LEAST = 0.8
#: a copy's words lie within so many lengths of its template; windows of the least width are tried first, the last bounds the words that may be put in
WIDTHS = (1.2, 2.0, 4.0)
# Short public notices by SPDX name.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (a, b), sorted by a, that increases in b."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(last[at - 1] if at else -1)
        tops[at : at + 1], last[at : at + 1] = [b], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(text: list, template: list) -> list[tuple[int, int]]:
    """(position in text, position in template) of the words that patience alignment matches, in order."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(text[a:b]).items() if n == 1} & {w for w, n in Counter(template[c:d]).items() if n == 1}
        where = {template[k]: k for k in range(c, d) if template[k] in once}
        anchors = _increasing([(k, where[text[k]]) for k in range(a, b) if text[k] in once])
        if not anchors:
            continue
        out += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        work += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:])]
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str], widths: tuple[float, ...] = WIDTHS):
        self.names, self.widths = sorted(texts), widths
        self.words = []
        for name in self.names:
            raw = np.frombuffer(texts[name].encode(), np.uint8)
            self.words.append(term_hashes(raw, np.array([0, len(raw)]))[0])
        self.own = [np.unique(w, return_counts=True) for w in self.words]  # distinct words, and how often the template has each

    def possible(self, terms: np.ndarray, least: float) -> list[int]:
        """The templates of whose words a text has enough, wherever they are."""
        found, times = np.unique(terms, return_counts=True)
        out = []
        for k, (own, most) in enumerate(self.own):
            if len(own) and len(found):
                at = np.minimum(np.searchsorted(found, own), len(found) - 1)
                if np.minimum(times[at], most)[found[at] == own].sum() >= int(np.ceil(least * len(self.words[k]))):
                    out.append(k)
        return out

    def _width(self, k: int, share: float) -> int:
        return int(np.ceil(share * len(self.words[k]) - 1e-9))

    def regions(self, terms: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """Stretches of a text in which template k may be covered by ``least``, merged; also right if its words repeat."""
        template, own = self.words[k], self.own[k][0]
        place = np.minimum(np.searchsorted(own, terms), len(own) - 1)
        hits = np.flatnonzero(own[place] == terms)
        width, needed = self._width(k, self.widths[-1]), int(np.ceil(least * len(template)))
        # any alignment within the widest window has ``needed`` words of the template there
        if len(hits) < needed:
            return []
        close = hits[needed - 1 :] - hits[: len(hits) - needed + 1] < width
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(close):
            a, b = max(0, int(hits[i]) - len(template)), min(len(terms), int(hits[i + needed - 1]) + len(template) + 1)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def _starts(self, terms: np.ndarray, k: int, least: float, width: int) -> np.ndarray:
        """Where an alignment of template k within ``width`` words may start: at one of its first words, with enough of its words behind."""
        template = self.words[k]
        own, times = self.own[k]
        needed = int(np.ceil(least * len(template)))
        place = np.minimum(np.searchsorted(own, terms), len(own) - 1)
        at = np.flatnonzero(own[place] == terms)
        order = at[np.argsort(place[at], kind="stable")]  # by word, then by position
        word = place[order]
        # a word counts in a window as often as the template has it at most: unless as many of the same are before it in the window
        same = np.arange(len(order)) - times[word]
        earlier = np.where((same >= 0) & (word[np.maximum(same, 0)] == word), order[np.maximum(same, 0)], -1)
        change = np.zeros(len(terms) + 1, np.int64)
        np.add.at(change, np.maximum(earlier, order - width) + 1, 1)
        np.add.at(change, order + 1, -1)
        enough = np.cumsum(change[:-1]) >= needed
        return np.flatnonzero(enough & np.isin(terms, template[: len(template) - needed + 1]))

    def _places(self, terms: np.ndarray, k: int, least: float, widths: tuple[int, ...]) -> list[list[tuple[int, int]]]:
        """Alignments of template k, one behind the other: those within the least width first, the wider ones in what is left between them."""
        template = self.words[k].tolist()
        if not widths or len(terms) < least * len(template):
            return []
        out, at, left = [], 0, 0
        moved = lambda match, by: [(p + by, q) for p, q in match]
        between = lambda a, b: [moved(m, a) for m in self._places(terms[a:b], k, least, widths[1:])]
        for p in self._starts(terms, k, least, widths[0]).tolist():
            if p < at:
                continue
            match = moved(aligned(terms[p : p + widths[0]].tolist(), template), p)
            if len(match) < least * len(template):
                continue
            # the window may begin before the copy and end within it
            again = moved(aligned(terms[match[0][0] : match[0][0] + widths[0]].tolist(), template), match[0][0])
            match = max(match, again, key=len)
            out += [*between(left, match[0][0]), match]
            at = left = match[-1][0] + 1
        return out + between(left, len(terms))

    def scan(self, terms: np.ndarray, least: float) -> list[tuple[str, float, int, int]]:
        """(name, coverage, first word, word after the last) of each place that covers a template.

        A window with several copies has no word only once, so windows are hardly longer than a copy at first; wider ones are for copies with
        words put in, and never reach over a copy that is found. At last each match takes in what more of its template lies around it.
        """
        found = []
        for k in self.possible(terms, least):
            name, template = self.names[k], self.words[k].tolist()
            size = len(template)
            for a, b in self.regions(terms, k, least):
                if not len(self._starts(terms[a:b], k, least, self._width(k, self.widths[-1]))):
                    continue  # what no window of the widest width could cover, none of a smaller one covers
                matches = self._places(terms[a:b], k, least, tuple(self._width(k, w) for w in self.widths))
                end = a
                for n, match in enumerate(matches):
                    first, last = a + match[0][0], a + match[-1][0] + 1
                    if len(match) < size:
                        widest = self._width(k, self.widths[-1])
                        begin = max(end, last - widest)
                        more = aligned(terms[begin : min(first + widest, a + matches[n + 1][0][0] if n + 1 < len(matches) else b)].tolist(), template)
                        if len(more) > len(match):
                            match, first, last = more, begin + more[0][0], begin + more[-1][0] + 1
                    found.append((name, len(match) / size, first, last))
                    end = last
        return found


def _scanned(templates: Templates, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in tb.pieces(batch.column(1)):
                terms, words = term_hashes(raw, offsets)
                every = np.unique(np.concatenate(templates.words)) if templates.names else np.zeros(0, np.uint64)
                some = np.concatenate([[0], np.cumsum(np.isin(terms, every))])
                few = min((int(np.ceil(least * len(w))) for w in templates.words if len(w)), default=1)
                rows, found = [], []
                for k in np.flatnonzero(np.diff(some[words]) >= few):
                    for x in templates.scan(terms[words[k] : words[k + 1]], least):
                        rows.append(k)
                        found.append(x)
                columns = list(zip(*found, strict=True)) or [[]] * 4
                ids = batch.column(0).slice(i, j - i).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["id", "license", "coverage", "first_word", "end_word"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, widths: tuple[float, ...] = WIDTHS) -> DataFrame:
    """(id, license, coverage, first_word, end_word), a row for each place of a text that covers a template by ``least``.

    Words are runs of letters and digits, lower-cased; positions count them from 0. A null or empty text has no license. Rows that
    repeat an id are scanned each; null ids are allowed; other columns are ignored. ``templates`` maps names to texts. A copy with words put in is found
    as long as it is no wider than the last of ``widths`` lengths of its template; the widths are tried in order, and a place found by a narrower one is not searched again.
    """
    own = Templates(TEMPLATES if templates is None else templates, widths)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(_scanned(own, least), "id long, license string, coverage double, first_word long, end_word long")
    return out.withColumnRenamed("id", id_col)
