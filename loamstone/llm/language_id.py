"""Language of every word by a linear-chain conditional random field, in code-switched text.

A word's features are its character n-grams with marks at both ends (those that touch a mark are its affixes) and the word itself
(a lexicon), hashed into one table of weights; transitions between the languages of neighbouring words are learned with them, by gradient steps on the likelihood
of labelled sequences. Forward-backward then gives each word's probabilities, and a text's language is the one with the largest
mean. Emissions of distinct words are looked up in a table of bounded size, and all texts of a chunk run side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from . import tokens as tk
from .io import saved

BITS, GRAMS = 16, (1, 2, 3, 4)
#: the bounds of what is learned from in each language: documents, and pieces of LENGTH // 2 words cut from those
TRAIN_DOCS, TRAIN_PIECES = 400, 2_000
LENGTH, STEPS = 64, 40
CHUNK = 3 << 19


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each word and the end of the last)."""
    text = b"".join(b"^" + w + b"$" for w in words)
    raw = np.frombuffer(text, np.uint8)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.cumsum(size)
    stop = np.repeat(end, size)
    found, owner = [], []
    at, word = np.arange(len(raw)), np.repeat(np.arange(len(words)), size)
    code = np.zeros(len(raw), np.uint64)
    for n in GRAMS:
        code[: len(raw) - n + 1] |= raw[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1))
        good = at + n <= stop
        found.append(tb.mix(code[good] + np.uint64(n << 40)) >> np.uint64(64 - BITS))
        owner.append(word[good])
    if len(words):
        found.append(tb.span_hashes(raw, end - size, end) >> np.uint64(64 - BITS))
        owner.append(np.arange(len(words)))
    owner_, found_ = np.concatenate(owner), np.concatenate(found).astype(np.int64)
    order = np.argsort(owner_, kind="stable")
    return found_[order], np.searchsorted(owner_[order], np.arange(len(words) + 1))


class Field:
    """Weights of features and transitions; languages in alphabetical order."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.weights = np.zeros((1 << BITS, len(languages)), np.float32)
        self.transitions = np.zeros((len(languages), len(languages)))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores by language; words without a letter get none."""
        found, first = features(words)
        sums = np.concatenate([np.zeros((1, self.weights.shape[1])), np.cumsum(self.weights[found], axis=0, dtype=np.float64)])
        out = np.diff(sums[first], axis=0)
        out[[not any(b >= 0x80 or 97 <= b <= 122 for b in w) for w in words]] = 0
        return out.astype(np.float32)

    def values(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For a PieceTable: the bits of a word's emissions."""
        k = len(self.languages)
        return np.full(len(words), k, np.int64), self.emissions(words).view(np.uint32).ravel()

    def marginals(self, scores: np.ndarray, first: np.ndarray, expected: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over sequences side by side: (each word's probabilities, expected counts of transitions if they are wanted)."""
        e = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        t = np.exp(self.transitions - self.transitions.max())
        alpha = np.empty(e.shape)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than each step
        a = np.ones((len(size), e.shape[1]))
        for i in range(longest):
            at = start[: active[i]] + i
            a = (a[: active[i]] @ t if i else a[: active[i]]) * e[at]
            a /= a.sum(1, keepdims=True)
            alpha[at] = a
        counts = np.zeros_like(t)
        for i in range(longest - 1, -1, -1):
            at = start[: active[i]] + i
            b = np.ones((active[i], e.shape[1]))
            if i + 1 < longest and active[i + 1]:
                m = active[i + 1]
                right = e[at[:m] + 1] * after
                b[:m] = right @ t.T
                b[:m] /= b[:m].sum(1, keepdims=True)
                if expected:
                    joint = alpha[at[:m]][:, :, None] * t * right[:, None, :]
                    counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            own = alpha[at] * b
            alpha[at] = own / own.sum(1, keepdims=True)
            after = b
        return alpha, counts


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = tb.lowered(raw)
    return low, *tb.word_bounds(raw, offsets)


def learn(pieces: list[tuple[str, str]], steps: int = STEPS) -> Field:
    """A field from (piece of a text, language) rows, all of which teach. Two pieces in a random order make a sequence, mostly of two languages, from which switches are learned."""
    field = Field(sorted({lang for _, lang in pieces}))
    if not field.languages:
        return field
    rng = np.random.default_rng(5)
    own = [(text.encode().lower().split(), field.languages.index(lang)) for text, lang in sorted(pieces)]
    order = rng.permutation(len(own))
    names: dict[bytes, int] = {}
    word = np.array([names.setdefault(w, len(names)) for p in order for w in own[p][0]], np.int64)
    gold = np.array([own[p][1] for p in order for _ in own[p][0]], np.int64)
    size = np.array([len(own[p][0]) for p in order])
    size = np.add.reduceat(size, np.arange(0, len(size), 2)) if len(size) else size
    first = np.concatenate([[0], np.cumsum(size)])
    k = len(field.languages)
    found, at = features(list(names))
    owner = np.repeat(np.arange(len(names)), np.diff(at))
    inner = np.ones(len(word), bool)
    inner[first[:-1][first[:-1] < len(word)]] = False
    pair = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[pair - 1], gold[pair]), 1)
    truth = np.zeros((len(word), k))
    truth[np.arange(len(word)), gold] = 1
    grown, grown_t = np.full(field.weights.shape, 1e-3), np.full((k, k), 1e-3)
    for _ in range(steps):
        scores = field.emissions(list(names))[word]
        probability, counts = field.marginals(scores, first)
        by_word = np.stack([np.bincount(word, (truth - probability)[:, c], len(names)) for c in range(k)], 1)
        slope = np.stack([np.bincount(found, by_word[owner, c], 1 << BITS) for c in range(k)], 1) / max(1, len(word)) - 1e-6 * field.weights
        slope_t = (seen - counts) / max(1, len(pair)) - 1e-3 * field.transitions
        grown, grown_t = grown + slope**2 * len(word), grown_t + slope_t**2 * len(word)
        field.weights += (0.3 * slope * len(word) ** 0.5 / np.sqrt(grown)).astype(np.float32)
        field.transitions += 0.3 * slope_t * len(word) ** 0.5 / np.sqrt(grown_t)
    return field


def _labelled(field: Field):
    digest = hashlib.sha256(repr(field.languages).encode() + field.weights.tobytes() + field.transitions.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tk.loaded("field", lambda: tk.PieceTable(field.values, bits=20), digest)
        kinds = tk.loaded("classes", tk._char_classes)
        k = len(field.languages)
        for batch in batches:
            raw_all, offsets_all = tb.flat(batch.column("text"))
            for i, j in tb.chunks(offsets_all, CHUNK):
                raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
                low, starts, ends, first = _words(raw, offsets)
                code, at = tk.code_points(raw)
                letters = np.concatenate([[0], np.cumsum(kinds[code] == tk.L)])
                some = np.diff(letters[np.searchsorted(at, offsets)]) > 0
                mean = np.zeros((j - i, max(1, k)))
                if len(starts) and k:
                    rank = table.ranks(low, starts, ends)
                    scores = table.items[(table.starts[rank][:, None] + np.arange(k))].view(np.float32)
                    probability, _ = field.marginals(scores, first, expected=False)
                    sums = np.concatenate([np.zeros((1, k)), np.cumsum(probability, axis=0)])
                    mean = np.diff(sums[first], axis=0) / np.maximum(1, np.diff(first))[:, None]
                best = mean.argmax(1)
                lang = [field.languages[b] if s and k else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                score = np.where(some & (k > 0), np.clip(mean[np.arange(j - i), best], 0, 1), 0.0)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["id", "held_out", "lang_pred", "score"])

    return run


def training_pieces(known: DataFrame, train_docs: int = TRAIN_DOCS, train_pieces: int = TRAIN_PIECES, languages: int | None = None) -> DataFrame:
    """(piece, lang): what a field learns from, of rows (text, lang).

    Of each language, or of each of the ``languages`` most frequent ones (ties by name) if they are bounded, at most ``train_docs`` distinct texts, those with the least hashes among about four
    times as many, and of these at most ``train_pieces`` pieces, by their hashes. So a rare language teaches at every size of the table, and the driver
    gets a number of words that the parameters bound for each language.
    """
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = saved(counts if languages is None else counts.orderBy(F.desc("n"), "lang").limit(languages))  # a table, so Spark knows its size and broadcasts it if it is small
    hashed = known.join(counts, "lang").withColumn("h", F.xxhash64("text"))
    # a first cut by the hash leaves about four times as many rows as wanted; copies of one text have one hash
    near = hashed.where(F.pmod("h", F.lit(1 << 30)) < (1 << 30) * 4.0 * train_docs / F.col("n")).dropDuplicates(["lang", "text"])
    first = Window.partitionBy("lang").orderBy("h", "text")
    texts = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= train_docs)
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    at = F.explode(F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"), F.lit(LENGTH // 2))))
    pieces = texts.select("lang", words.alias("words")).select("lang", "words", at.alias("at")).select("lang", F.array_join(F.slice("words", F.col("at"), F.lit(LENGTH // 2)), " ").alias("piece"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    return pieces.withColumn("k", F.row_number().over(order)).where(F.col("k") <= train_pieces).select("piece", "lang")


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_pieces: int = TRAIN_PIECES, languages: int | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score), a row for each row of ``docs``; ``held_out`` is a condition on its columns.

    Only texts with a language that are not held out teach, within the bounds of ``training_pieces``. A null text, or one without a letter, is ``und``
    with score 0; so is every text if nothing teaches. score is the mean probability of the language over the words; of languages with equal means
    the first by name is given. Repeated and null ids are rows of their own; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(lang_col).alias("lang"))
    known = texts.where("not held_out and lang is not null and text is not null").select("text", "lang")
    field = learn([(r.piece, r.lang) for r in training_pieces(known, train_docs, train_pieces, languages).collect()])
    out = texts.select("id", "text", "held_out").mapInArrow(_labelled(field), "id long, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
