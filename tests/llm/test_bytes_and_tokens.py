"""Array-level parts against plain Python: words, cuts, token counts, buckets, alignment, the random field."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from loamstone.llm import decontaminate, language_id, license_scan, minhash, suffix_dedup, toxicity
from loamstone.llm import textbytes as tb
from loamstone.llm import tokens as tk

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("ab'sstrevlmd  \n\t.,!é1٣ 你　ǅ|#")


def texts(n=3000, seed=1, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", " ", "\n", "'", "'re", "x'll"]


def test_words_are_those_of_the_pattern():
    own = texts()
    raw, offsets = tb.flat(pa.array([*own, None]))
    starts, ends, first = tb.word_bounds(raw, offsets)
    found = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
    assert found == [w for t in own for w in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())]
    assert np.diff(first).tolist() == [len(re.findall(rb"[^\x20\x09-\x0d]+", t.encode())) for t in own] + [0]


def test_cuts_are_those_of_the_pattern():
    own = texts()
    raw, offsets = tb.flat(pa.array(own))
    pattern = regex.compile(public_tokenizers.PATTERN)
    wanted = [int(o) + len(t[: m.start()].encode()) for t, o in zip(own, offsets) for m in pattern.finditer(t)]
    assert tk.piece_starts(raw, offsets).tolist() == wanted
    for width in (1, 7, 128):
        assert tk.CutTransducer(width).starts(raw, offsets).tolist() == wanted


def test_counts_are_those_of_the_library():
    from tokenizers import Tokenizer

    tokenizer, count = Tokenizer.from_file(VOCABULARY), tk.CountTransducer(VOCABULARY)
    own = [t for t in texts(1500, 3) if len(regex.findall(public_tokenizers.PATTERN, t)) == 1] + [" transformation", " aaaaaaaaaaaaaaaa", "\n\n\n", " 12345678901", "naïveté", " thtionerreou"]
    for t in own:
        assert count.count(t.encode()) == len(tokenizer.encode(t, add_special_tokens=False).ids), t


@pytest.mark.parametrize("width,most,rows", [(1, 50, 3), (7, 1 << 15, 1024), (64, 300, 2), (64, 1 << 15, 1024)])
def test_chunk_maps_of_counts_compose(width, most, rows, monkeypatch):
    """Whole batches at any chunk width, with pieces longer than many chunks, while the table of states starts over."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tk.CountTransducer, "ROWS", rows)
    tokenizer, count = Tokenizer.from_file(VOCABULARY), tk.CountTransducer(VOCABULARY, width, most)
    rng = random.Random(width + most)
    own = [*texts(150, 5, 60), "a" * 700, "x" + "=" * 400, "".join(rng.choice("abcXYZ019") for _ in range(900)), " " * 300, "", "é" * 200, "the cat sat " * 30]
    raw, offsets = tb.flat(pa.array(own))
    found = np.diff(count.totals(raw, tk.CutTransducer().starts(raw, offsets))[offsets])
    assert found.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in own]
    assert len(count.states) <= most + rows * width + 2


def test_special_strings_are_those_of_the_file(tmp_path):
    import json

    file = json.load(open(VOCABULARY, encoding="utf-8"))
    assert tk.special_strings(VOCABULARY) == [b"<|endoftext|>"]
    file["added_tokens"] += [{**file["added_tokens"][0], "id": 50257, "content": "<|end"}]
    (tmp_path / "more.json").write_text(json.dumps(file), encoding="utf-8")
    pattern = tk.special_pattern(str(tmp_path / "more.json"))
    assert pattern.split(b"a<|endoftext|>b<|endless<|") == [b"a", b"b", b"less<|"]
    file["added_tokens"] = []
    (tmp_path / "none.json").write_text(json.dumps(file), encoding="utf-8")
    assert tk.special_pattern(str(tmp_path / "none.json")) is None


def test_a_full_piece_table_starts_over():
    table = tk.PieceTable(lambda found: (np.array([len(p) for p in found]), np.frombuffer(b"".join(found), np.uint8).astype(np.uint32)), bits=4)
    for k in range(30):
        words = [f"w{k}-{i}".encode() for i in range(5)]
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        rank = table.ranks(raw, ends - [len(w) for w in words], ends)
        assert tk.gathered(table.items, table.starts[rank], table.lengths[rank].astype(np.int64)).astype(np.uint8).tobytes() == b"".join(words)


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(0)
    orders = minhash._orders(128)
    for size in (1, 3, 40, 2000):
        whole = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).view(np.uint64) * np.uint64(2))
        part = whole[: max(1, int(size * 0.9))]
        agree = np.mean(minhash.signature(whole, orders) == minhash.signature(part, orders))
        assert abs(agree - len(part) / len(whole)) < 0.35 if size < 40 else abs(agree - 0.9) < 0.12


def test_half_buckets_name_equal_strings_alike():
    raw = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789" * 3 + b"x", np.uint8)
    ids = suffix_dedup.half_buckets(raw, 50)
    by = {}
    for i, x in enumerate(ids.tolist()):
        by.setdefault(raw[i : i + 50].tobytes(), set()).add(x)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_patience_alignment():
    template = "permission is granted to use copy and modify the software".split()
    assert len(license_scan.aligned("foo bar permission is hereby granted to use copy or modify the software baz".split(), template)) == 9
    assert license_scan.aligned([], template) == [] and license_scan.aligned(template, []) == []
    assert license_scan.aligned(template, template) == [(k, k) for k in range(len(template))]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        found = license_scan.aligned(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:]))


def test_folding():
    assert toxicity.fold("You 1d10t, CL0WN!!") == " you idiot clown "
    assert toxicity.fold("іdіоt&&& m0r0n$$$ 1234") == " idiot moron "
    assert toxicity.fold("") == "  "


def test_lexicon_finds_terms_and_spares_exceptions():
    filler = "the quick brown fox jumps over a lazy dog near some river bank".split()
    rng = random.Random(4)
    line = lambda *more: " ".join(rng.sample(filler, 8) + list(more))
    rows = [(line("you", rng.choice(["idiot", "scum"])), 1) for _ in range(60)] + [(line(rng.choice(["you", "me"])), 0) for _ in range(300)] + [(line("pond", "scum"), 0) for _ in range(12)]
    lexicon = toxicity.learn(rows)
    automaton = lexicon.automaton()
    score = lambda t: lexicon.score(lexicon.evidence(toxicity.fold(t), automaton))
    assert {"idiot", "scum"} <= set(lexicon.weights) and score("what an 1d10t you are") > 0.5 > score("the river bank") and score("the river has pond scum") < 0.5
    assert toxicity.learn([]).score(0) <= 0.5


@pytest.mark.parametrize("seed", range(3))
def test_evidence_is_that_of_plain_search(seed):
    """The automaton and its sweep against a search of every term and phrase at every place, with ties, overlaps and repeats."""
    import math

    rng = random.Random(seed)
    letters = "ab" if seed else "abc"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    for _ in range(60):
        weights = {w + rng.choice(["", "-"]): rng.choice([1.0, 2.0, 2.5]) for w in (word() for _ in range(rng.randint(0, 6)))}
        weights = {t: w for t, w in weights.items() if t != "-"}
        lexicon = toxicity.Lexicon(weights, {f"{word()} {word()}" for _ in range(rng.randint(0, 5))})
        text = toxicity.fold(" ".join(word() for _ in range(rng.randint(0, 60))))
        shields = [(m, m + len(p) + 1) for p in lexicon.exceptions for m in range(len(text)) if text.startswith(f" {p} ", m)]
        total = 0.0
        for at in range(len(text)):
            fits = [w for t, w in weights.items() if text.startswith(f" {t[:-1]}" if t.endswith("-") else f" {t} ", at)]
            if fits and not any(a <= at < b for a, b in shields):
                total += max(fits)
        wanted = math.log1p(100 * total / (text.count(" ") + 20)) if weights or lexicon.exceptions else 0.0
        assert abs(lexicon.evidence(text, lexicon.automaton()) - wanted) < 1e-9


def test_each_window_that_covers_a_template_is_found():
    """``scan`` against an alignment of every window: each window that covers a template meets a place found, and each place covers it."""
    template = "permission is granted to use copy and modify the software for any purpose and without fee".split()
    templates = license_scan.Templates({"t": " ".join(template)})
    hashed = lambda words: license_scan.term_hashes(raw := np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(raw)]))[0] if words else np.zeros(0, np.uint64)
    rng = random.Random(7)
    for case in range(150):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(["the", "and", "use", "x", "y", "rain"]) for _ in range(rng.choice([0, 0, 1, 3, 12]))]
            copy = template[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                p = rng.randrange(len(copy))
                copy[p : p + rng.randint(0, 1)] = [rng.choice(["z", "the", "and"])] * rng.choice([0, 1, 1, 9])
            text += copy
        found = templates.scan(hashed(text), 0.8)
        for _, coverage, a, b in found:
            assert coverage >= 0.8 and len(license_scan.aligned(text[a:b], template)) >= round(coverage * len(template)) - 1
        assert all(x[3] <= y[2] for x, y in zip(found, found[1:]))
        for p in range(len(text)):
            for width in (1.2, 2.0, 4.0):
                match = license_scan.aligned(text[p : p + int(np.ceil(width * len(template)))], template)
                if len(match) >= 0.8 * len(template):
                    assert any(p + match[0][0] < b and a <= p + match[-1][0] for *_, a, b in found), (case, p, width, found)


def test_forward_backward_against_enumeration():
    from itertools import product

    field = language_id.Field(["a", "b", "c"])
    rng = np.random.default_rng(1)
    field.transitions = rng.normal(size=(3, 3))
    scores, first = rng.normal(size=(9, 3)), np.array([0, 4, 4, 9])
    found, counts = field.marginals(scores, first)
    total = np.zeros((3, 3))
    for a, b in zip(first, first[1:]):
        weight, own, pairs = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=b - a):
            w = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(field.transitions[x, y] for x, y in zip(path, path[1:])))
            weight += w
            for i, y in enumerate(path):
                own[i, y] += w
            for x, y in zip(path, path[1:]):
                pairs[x, y] += w
        if b > a:
            assert np.allclose(found[a:b], own / weight)
            total += pairs / weight
    assert np.allclose(counts, total)


def test_words_of_a_code_switched_text_are_told_apart():
    rng = random.Random(5)
    de, fr = "der und nicht eine schule keiten wald".split(), "le une avec pour que eau reaux".split()
    field = language_id.learn([(" ".join(rng.choices(de, k=30)), "de") for _ in range(40)] + [(" ".join(rng.choices(fr, k=30)), "fr") for _ in range(40)])
    words = [w.encode() for w in rng.choices(de, k=10) + rng.choices(fr, k=10)]
    found, _ = field.marginals(field.emissions(words), np.array([0, 20]))
    assert found.argmax(1).tolist() == [0] * 10 + [1] * 10


@pytest.mark.parametrize("seed", range(4))
def test_retrieval_is_that_of_exhaustive_scores(seed, monkeypatch):
    """Every passage against every segment: the same segments with the same scores, over several blocks and slabs, with ties and repeated items."""
    monkeypatch.setattr(decontaminate, "SLAB", [1, 3, 256, 2][seed])
    monkeypatch.setattr(decontaminate, "BLOCK", [16, 4, 1, 64][seed])
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of", "a"] * 100
    items = {k: " ".join(rng.choices(vocabulary, k=rng.randint(3, 120))) for k in range(150)}
    items |= {200: items[7], 201: "the of", 202: "w3"}
    rows = []
    for batch in decontaminate._entries(iter([pa.RecordBatch.from_arrays([pa.array(list(items)), pa.array(list(items.values()))], names=["i", "t"])])):
        rows += batch.to_pylist()
    df = Counter(r["term"] for r in rows)
    impact = np.array([np.log(1 + 200 / df[r["term"]]) * r["tf"] / (r["tf"] + 1) for r in rows])
    item, entry, term = (np.array([r[c] for r in rows], np.int64) for c in ("item", "entry", "term"))
    index = decontaminate.Index(item, entry, term.view(np.uint64), impact, items)
    docs = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 300))) for _ in range(60)] + [f"{rng.choice(list(items.values()))} tail" for _ in range(20)] + ["", "w3"]
    raw, offsets = tb.flat(pa.array(docs))
    terms, words = decontaminate.term_hashes(raw, offsets)
    own: dict = {}
    for i, e, t, x in zip(item, entry, term.view(np.uint64), impact):
        own.setdefault((int(i), int(e)), {})[int(t)] = x
    for threshold in (0.2, 0.5, 1.0):
        wanted: dict = {}
        for d in range(len(docs)):
            for at in range(0, max(1, words[d + 1] - words[d]), decontaminate.SEGMENT):
                passage = set(terms[words[d] + at : min(words[d] + at + 2 * decontaminate.SEGMENT, words[d + 1])].tolist())
                for (i, _), weights in own.items():
                    score = sum(w for t, w in weights.items() if t in passage) / sum(weights.values())
                    if score >= threshold - 1e-9:
                        wanted[d, i] = max(score, wanted.get((d, i), 0.0))
        found = {(d, i): s for d, i, s in index.retrieve(terms, words, threshold)}
        assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in found) and found


def test_other_tokenizer_files_are_refused(spark, tmp_path):
    """A file that cuts, normalises or merges in another way would be miscounted."""
    import json

    import public_tokenizers

    from loamstone.llm import packing, token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    file = json.load(open(path, encoding="utf-8"))
    docs = spark.createDataFrame([(1, "123 456")], "doc_id long, text string")
    changes = [
        {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, file["pre_tokenizer"]]}}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}},
        {"pre_tokenizer": None}, {"model": file["model"] | {"ignore_merges": True}}, {"model": file["model"] | {"type": "Unigram"}},
    ]
    for k, change in enumerate(changes):
        other = str(tmp_path / f"{k}.json")
        json.dump(file | change, open(other, "w", encoding="utf-8"))
        for use in (token_counts.count_tokens, packing.pack):
            with pytest.raises(ValueError, match="byte-level"):
                use(docs, other)
    assert token_counts.count_tokens(docs, path).first().n_tokens > 0


def test_very_many_equal_rows_in_suffix_dedup(spark):
    """Their spans are those of one row, not all rows' together."""
    from loamstone.llm import suffix_dedup

    text = " ".join(f"word{k}" for k in range(300))
    rows = spark.range(20_000).selectExpr("cast(null as long) as doc_id", f"'{text}' as text")
    assert suffix_dedup.repeated_spans(rows).selectExpr("size(starts) as n").first().n < 100
    found = suffix_dedup.repeat_digest(rows).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in found] == [(len(text), len(text), 1, 20_000)]


def test_equal_windows_have_equal_anchors_in_chunks_of_all_sizes(monkeypatch):
    """Identifiers whose high bits tie are told apart alike, whatever the size of the chunk that a text lies in."""
    real = suffix_dedup.half_buckets
    monkeypatch.setattr(suffix_dedup, "half_buckets", lambda raw, half: real(raw, half) >> np.uint64(32))
    letters = np.random.default_rng(1).integers(97, 123, 1_000_000).astype(np.uint8)
    alone = suffix_dedup.Windows(letters[:20_000], np.array([0, 20_000]), 400)
    beside = suffix_dedup.Windows(letters, np.array([0, 20_000, len(letters)]), 400)
    assert (alone.anchor == beside.anchor[: len(alone.anchor)]).all()
