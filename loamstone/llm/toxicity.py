"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, turns homoglyphs and digits that stand for letters into those letters, and reads everything that is no letter as
one blank. The lexicon is learned from labelled rows: words and beginnings of words whose presence speaks for the label, chosen one after another by the toxic texts that
no earlier term explains, weighted by log odds. Pairs of neighbouring words around a term that speak against the label are exception phrases; a match inside one does
not count. The weights found are divided by the number of words, and a logistic curve fitted on the same rows turns the logarithm of that into a score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk

# Characters that stand for letters, by the letter.
LOOKALIKES = {
    "a": "@4аαàáâãäå", "b": "8вβ", "c": "сçć", "e": "3еεèéêë", "g": "9ɡ", "h": "һн", "i": "1!|іìíîïι", "k": "кκ", "l": "ł",
    "m": "м", "n": "ñηп", "o": "0оοòóôõöσ", "p": "рρ", "s": "5$ѕš", "t": "7+тτ", "u": "υùúûü", "x": "хχ", "y": "уγýÿ", "z": "2ž",
}
_FOLD = {ord(sign): letter for letter, signs in LOOKALIKES.items() for sign in signs}
_STANDS = re.escape("".join(s for signs in LOOKALIKES.values() for s in signs if not s.isalpha()))
_INSIDE = re.compile(rf"(?:(?<=[^\W\d_])|(?<=[^\W\d_][{_STANDS}]))[{_STANDS}](?=[{_STANDS}]*[^\W\d_])|(?<!\S)[{_STANDS}](?=[^\W\d_])")
_BLANK = re.compile(r"[\W\d_]+")
#: the fit sees at most about this many labelled rows, chosen by a hash of their ids
TRAIN_ROWS = 10_000
#: lengths of beginnings of words that may be terms; such a term is written with a hyphen
ROOTS = range(3, 9)


def fold(text: str) -> str:
    """The folded words, with one blank before, between and after them.

    A digit or sign is read as a letter only inside a word, or at its start; marks after a word are no letters.
    """
    text = _INSIDE.sub(lambda m: _FOLD.get(ord(m[0]), m[0]), text.lower())
    return f" {_BLANK.sub(' ', text.translate(_FOLD_LETTERS)).strip()} "


_FOLD_LETTERS = {c: x for c, x in _FOLD.items() if chr(c).isalpha()}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    slope: float = 1.0
    shift: float = -2.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            own = f" {term[:-1]}" if term.endswith("-") else f" {term} "
            found.add_word(own, (len(own) - 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 1, None))
        found.make_automaton()
        return found

    @staticmethod
    def evidence(folded: str, automaton) -> float:
        """The weights of the matches outside exception phrases, by length."""
        if not len(automaton):
            return 0.0
        hits, shields = {}, []
        for end, (size, weight) in automaton.iter(folded):
            if weight is None:
                shields.append((end - size, end))
            else:  # of terms that start one word the heaviest counts
                hits[end - size] = max(weight, hits.get(end - size, 0.0))
        total, k, reach = 0.0, 0, -1  # one sweep: ``reach`` is the farthest end of the phrases that begin at or before a match
        shields.sort()
        for a in sorted(hits):
            while k < len(shields) and shields[k][0] <= a:
                reach = max(reach, shields[k][1])
                k += 1
            total += hits[a] if a >= reach else 0.0
        return math.log1p(100 * total / (folded.count(" ") + 20))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.shift))))


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """A lexicon from (text, toxic) rows; equal texts count once. Without rows of both kinds it scores every text alike."""
    folded = {}
    for text, toxic in rows:
        folded.setdefault(fold(text or ""), []).append(toxic)
    kinds = {t: round(sum(x) / len(x)) for t, x in folded.items()}
    bad, good = sum(kinds.values()), len(kinds) - sum(kinds.values())
    lexicon = Lexicon(shift=math.log((bad + 1) / (good + 1)))
    if not bad or not good:
        return lexicon
    texts = list(kinds)
    terms = lambda t: {x for w in set(t.split()) for x in (w, *(f"{w[:n]}-" for n in ROOTS if n < len(w)))}
    parts = lambda w: (w, *(f"{w[:n]}-" for n in ROOTS if n < len(w)))
    words = [Counter(t.split()) for t in texts]
    presence: dict[str, list[int]] = defaultdict(list)
    for k, t in enumerate(texts):
        if kinds[t]:
            for x in {x for w in words[k] for x in parts(w)}:
                presence[x].append(k)
    least = max(3, 0.01 * bad)
    presence = {x: p for x, p in presence.items() if len(p) >= least}
    uses, clean, size = Counter(), Counter(), [0, 0]  # by term and kind; clean texts with the term; words by kind
    for k, t in enumerate(texts):
        size[kinds[t]] += words[k].total()
        seen = set()
        for w, n in words[k].items():
            for x in parts(w):
                if x in presence:
                    uses[x, kinds[t]] += n
                    seen.add(x)
        if not kinds[t]:
            clean.update(seen)
    odds = {x: math.log((uses[x, 1] + 0.5) / (size[1] + 1)) - math.log((uses[x, 0] + 0.5) / (size[0] + 1)) for x in presence}
    open_, uncovered = {x for x, o in odds.items() if o > 1.5}, {k for k, t in enumerate(texts) if kinds[t]}
    while open_:  # each round explains a hundredth of the toxic texts or is the last
        # the most toxic texts not yet explained, less a quarter of the clean texts that it is found in
        gain, best = max((len(uncovered.intersection(presence[x])) - 0.25 * clean[x], odds[x], x) for x in open_)[::2]
        if gain < least:
            break
        lexicon.weights[best] = odds[best]
        uncovered -= set(presence[best])
        open_.discard(best)
    # and the terms that say as much about texts that are explained already
    known = lambda x: x in lexicon.weights or any(f"{x[:n]}-" in lexicon.weights for n in ROOTS if n < len(x.rstrip("-")))
    for x in sorted(open_, key=lambda x: (x.endswith("-"), x)):
        if not known(x) and odds[x] > 4 and len(presence[x]) >= 0.1 * bad and clean[x] < 0.02 * len(presence[x]) and not any(x[:-1] == w[: len(x) - 1] for w in lexicon.weights if x.endswith("-")):
            lexicon.weights[x] = odds[x]
    around = Counter()
    for t in texts:
        each = t.split()
        pairs = {f"{a} {b}" for a, b in zip(each, each[1:]) if b in lexicon.weights or a in lexicon.weights}
        for p in pairs:
            around[p, kinds[t]] += 1
    lexicon.exceptions = {p for (p, kind), n in around.items() if kind == 0 and n >= 3 and n > 10 * around[p, 1]}
    _fit(lexicon, texts, kinds)
    return lexicon


def _fit(lexicon: Lexicon, texts: list[str], kinds: dict[str, int]) -> None:
    """Slope and shift by Newton steps of a slightly regularised logistic regression."""
    automaton = lexicon.automaton()
    x = np.array([lexicon.evidence(t, automaton) for t in texts])
    y = np.array([kinds[t] for t in texts], float)
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.array([0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    lexicon.slope, lexicon.shift = map(float, w)


def _scored(lexicon: Lexicon):
    digest = hashlib.sha256(repr((sorted(lexicon.weights.items()), sorted(lexicon.exceptions))).encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = tk.loaded("lexicon", lexicon.automaton, digest)
        for batch in batches:
            scores = [lexicon.score(lexicon.evidence(fold(t), automaton)) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"], "score": np.array(scores, float)})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, held_out, score, predicted), a row for each row of ``docs``; ``held_out`` is a condition on its columns.

    ``labels`` has the id and toxic (1 or 0; null ignored, of repeated labels the largest counts). Only rows that are not held out teach, at most about
    ``train_rows`` of them. A null or empty text has no evidence and gets the score of none. Repeated and null ids are rows of
    their own. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    known = labels.where("toxic is not null").groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    rows = texts.where("not held_out").join(F.broadcast(known), "id").select("text", "toxic").limit(2 * train_rows).collect()  # bounded by train_rows
    lexicon = learn(sorted((r.text, int(r.toxic > 0)) for r in rows))
    out = texts.mapInPandas(_scored(lexicon), "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
