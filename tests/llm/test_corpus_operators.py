"""Operators on small tables with odd rows, against brute force; empty tables; every query on the smallest data."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone.llm import decontaminate, language_id, license_scan, minhash, packing, quality, suffix_dedup, token_counts, toxicity, url_filter
from loamstone.llm.components import components
from loamstone.llm.queries import ORACLE_SQL, QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# extra columns whose names the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, n long, bands string, x string, key string, rep string, rule string, component string, held_out string, stratum string"
WORDS = "the of and to schnell über être niño re'll data 12 rain tree stone river cloud glass ##".split()


def rows(seed=3, n=60):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(k))
    base = [say(rng.randint(0, 150)) for _ in range(n)]
    long = say(4000)
    near = long.split()
    near[700:730] = say(30).split()
    line = say(70)
    texts = [None, "", "  \n\t ", "one", "one two", "ONE two", *base, base[5], base[5].upper(), long, long, " ".join(near), f"{line}\n{line}\n{line}", f"x {line} y {say(90)}", "a" * 3000, "é" * 900, "b<|endoftext|>c <|endoftext|>"]
    out = [(k, t, ["en", "de", None][k % 3], None, None, -k, 7, 8, "b", "x", "k", "r", "u", "c", "h", "s") for k, t in enumerate(texts)]
    return [*out, out[8], (12, "another text under a known id", *out[8][2:]), (None, long, *out[8][2:]), (None, None, *out[8][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "text")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(70)] + [(3, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def expected_components(own, size, percent):
    ids = sorted({i for i, _ in own if i is not None})
    sets = {}
    for i, t in own:
        if i is not None and shingles(t, size):
            sets.setdefault(i, []).append(shingles(t, size))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs):
    found = minhash.near_duplicates(docs, shingle=3, percent=85).collect()
    wanted = expected_components([r[:2] for r in rows()], 3, 85)
    assert len(found) == len(rows())
    for r in found:
        assert r.component_id == (wanted[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    counts = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in found)
    assert counts == sorted((i is None, i or 0, len(shingles(t, 3))) for i, t, *_ in rows())


def test_near_copies_that_the_hub_does_not_link(spark):
    """A group of many near copies: links between copies that are no copies of the hub, chains, several blocks."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    own = []
    for k in range(700):
        words = base[:]
        for p in rng.sample(range(120), rng.choice([1, 3, 4, 5, 8])):
            words[p] = f"x{rng.randint(0, 10**6)}"
        own.append((k * 3 % 2101, " ".join(words)))
    for k in range(60):  # a chain of prefixes
        own.append((5000 + k, " ".join(base[: 120 - k])))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(own, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert found == expected_components(own, 3, 85)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(None, 3), (4, 4)]
    found = {r.id: r.component for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert found == {i: find(i) for i in root}


def expected_repeats(texts, window):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for k, b in enumerate(data):
        for p in range(len(b) - window + 1):
            seen.setdefault(b[p : p + window], []).append((k, p))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + window] = b"\1" * window
    return data, gone


@pytest.mark.parametrize("window", [64, 400])
def test_repeats(docs, window):
    own = rows()
    data, gone = expected_repeats([r[1] for r in own], window)
    wanted = sorted(
        (str(r[0]), len(b), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()) for r, b, g in zip(own, data, gone)
    )
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digest(docs, window=window).collect())
    assert found == wanted
    kept = suffix_dedup.without_repeats(docs, window=window)
    assert kept.columns == docs.columns and kept.count() == len(own)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_random_edits(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefg \n") for _ in range(3000))
    texts = []
    for _ in range(25):
        t = list(base[rng.randint(0, 1500) : rng.randint(1600, 3000)])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    texts.append("ab" * 700)
    data, gone = expected_repeats(texts, 400)
    found = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert found == {k: sum(g) for k, g in enumerate(gone)}


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = {}
    for r in rows():
        ids.setdefault(r[0], []).append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])
    found = packing.pack(docs, VOCABULARY, with_ids=True).collect()
    assert len({r.sequence_id for r in found}) == len(found) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 for r in found)
    for r in found:
        own = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and x[r.start : r.start + r.length] == r.ids]
        assert own and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in found) == sum(len(x) for each in ids.values() for x in each)
    with pytest.raises(ValueError):
        packing.pack(docs, VOCABULARY, longest=1000)


def test_token_counts(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    wanted = sorted((str(r[0]), len((r[1] or "").encode()), n := len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, VOCABULARY).collect()) == wanted


def test_quality_base_and_bounds(spark, docs, labels):
    from math import comb

    for r in quality.quality_rules(docs, labels).collect():
        texts = [t for i, t, *_ in rows() if i == r.doc_id]
        ok = False
        for t in texts:
            words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
            grams = {}
            for i in range(len(words) - 4):
                grams.setdefault(tuple(words[i : i + 5]), []).append(i)
            covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
            lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
            ok |= (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert ok and r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    cases = [(50, 0, 0.02), (400, 9, 0.02), (1000, 3, 0.005)]
    frame = spark.createDataFrame(cases, "n long, k long, a double")
    for n, k, a in cases:
        got = frame.where(f"n = {n}").select(quality.binomial_tail(F.col("n"), F.col("k"), a)).first()[0]
        assert abs(got - sum(comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))) < 1e-9


def test_cutoffs_control_false_rejections(spark):
    rng = np.random.default_rng(3)
    good = [("s", True, float(x), 0.0, 5.0) for x in rng.uniform(0, 0.05, 4000)]
    bad = [("s", False, float(x), 0.0, 5.0) for x in rng.uniform(0.25, 3, 400)]
    few = [("rare", True, 0.0, 0.0, 5.0)] * 20 + [("rare", False, 2.0, 0.0, 5.0)] * 20
    frame = spark.createDataFrame(good + bad + few, "stratum string, good boolean, symbol_share double, dup_line_share double, long_word double")
    found = {(r.stratum, r.rule): r.cutoff for r in quality.certified_cutoffs(frame).collect()}
    assert set(found) == {("s", "symbol_share")} and 0.05 <= found["s", "symbol_share"] <= 0.3


def test_selection_is_that_of_plain_python(spark):
    """Cutoffs of generated labels against exact binomial tails and a loop over the grid, with ties and strata that certify and that do not."""
    from math import comb

    rng = random.Random(5)
    own = []
    for stratum, n, share in (("a", 3000, 0.002), ("b", 900, 0.004), ("c", 60, 0.0), ("d", 2500, 0.2)):
        for _ in range(n):
            good = rng.random() < 0.8
            bad_sign = rng.random() < (share if good else 0.5)
            own.append((stratum, good, rng.choice([0.3, 0.6, 1.2, 3.0]) if bad_sign else rng.choice([0.0, 0.05]), rng.choice([0.0, 0.1, 0.25]) if good else rng.random(), rng.choice([5.0, 6.0, 13.0 if rng.random() < 0.01 else 7.0])))
    frame = spark.createDataFrame(own, "stratum string, good boolean, symbol_share double, dup_line_share double, long_word double")
    for alpha, delta, cost in ((0.02, 0.05, 10.0), (0.1, 0.2, 1.0)):
        wanted = {}
        for stratum in "abcd":
            for at, (rule, grid) in enumerate(quality.GRIDS.items()):
                rows_ = [(r[1], r[2 + at]) for r in own if r[0] == stratum]
                n, best = sum(g for g, _ in rows_), (0.0, 0, None)
                for level, cutoff in enumerate(grid):
                    k, caught = sum(g and x >= cutoff for g, x in rows_), sum(not g and x >= cutoff for g, x in rows_)
                    rate = alpha / 3
                    if k > rate * n or sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1)) > delta / 12:
                        break
                    if caught - cost * k > best[0]:
                        best = (caught - cost * k, level, cutoff)
                if best[2] is not None:
                    wanted[stratum, rule] = best[2]
        found = {(r.stratum, r.rule): r.cutoff for r in quality.certified_cutoffs(frame, alpha=alpha, delta=delta, good_cost=cost).collect()}
        assert found == wanted and wanted


def test_quality_against_sql_where_cutoffs_reject(spark, data):
    """With looser bounds than the query's, so that few labels certify cutoffs: SQL and operator agree, and cutoffs do reject."""
    duckdb = pytest.importorskip("duckdb")
    d = data.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    bounds = {"alpha": 0.3, "delta": 0.9, "good_cost": 1.0}
    found = quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), **bounds)
    rows_ = found.collect()
    wanted = con.sql(f"select {', '.join(found.columns)} from ({quality.oracle_sql(**bounds)})").fetchall()
    assert sorted(map(str, map(tuple, rows_))) == sorted(map(str, wanted))
    assert sum(not r.kept and not r.base_failed for r in rows_) > 5


def test_each_language_teaches_at_every_size(spark):
    """A language with one text in a thousand is learned; bounds on documents and pieces hold; copies count once."""
    own = [(f"the cat sat on mat{k % 900} and ran", "en") for k in range(3000)] + [("ein hund lief durch wald " * 40, "de")] * 3 + [("le chat", "fr"), ("", "xx")]
    known = spark.createDataFrame(own, "text string, lang string")
    found = language_id.training_pieces(known, train_docs=50, train_pieces=30).collect()
    count = {x: sum(r.lang == x for r in found) for x in ("en", "de", "fr", "xx")}
    assert count == {"en": 30, "de": 7, "fr": 1, "xx": 0}
    assert {r.lang for r in language_id.training_pieces(known, languages=1).collect()} == {"en"}
    named = language_id.identify(spark.createDataFrame([(1, "hund wald lief", "de"), (2, "le chat", None), *[(10 + k, *r) for k, r in enumerate(own)]], "doc_id long, text string, lang string"), F.col("doc_id") < 3)
    assert {r.doc_id: r.lang_pred for r in named.where("doc_id < 3").collect()} == {1: "de", 2: "fr"}


def test_a_text_is_named_by_the_mean_of_its_words(spark):
    """The result of every text against a plain forward-backward, word by word, of the same learned field; ties, mixed and repeated texts."""
    rng = random.Random(21)
    vocabulary = {"de": "der und nicht eine schule wald keit".split(), "fr": "le une avec pour que eau reaux".split(), "en": "the with and house water".split()}
    own = [(k, " ".join(rng.choices(vocabulary[lang], k=rng.randint(1, 40))), lang) for k, lang in enumerate(rng.choices(["de", "fr", "en"], k=90))]
    asked = [(k, " ".join(rng.choices(vocabulary["de"], k=3) + rng.choices(vocabulary["fr"], k=rng.randint(0, 6))) + ["", " 12 !", "\n\n"][k % 3], None) for k in range(1000, 1040)]
    asked += [(2000, "12 34", None), (2001, "", None), (2002, None, None), (2003, "x", None), (1000, asked[0][1], None)]
    frame = spark.createDataFrame(own + asked, "doc_id long, text string, lang string")
    pieces = language_id.training_pieces(frame.where("lang is not null").select("text", "lang")).collect()
    field = language_id.learn([(r.piece, r.lang) for r in pieces])
    step = np.exp(field.transitions - field.transitions.max())

    def name(text):
        words = (text or "").encode().lower().split()
        if not re.search(r"[^\W\d_]", text or ""):
            return "und", 0.0
        e = np.exp(field.emissions(words).astype(float))
        forward, backward = [e[0] / e[0].sum()], [np.ones(3)]
        for x in e[1:]:
            a = forward[-1] @ step * x
            forward.append(a / a.sum())
        for x in e[:0:-1]:
            b = step @ (x * backward[-1])
            backward.append(b / b.sum())
        each = [a * b / (a * b).sum() for a, b in zip(forward, backward[::-1])]
        mean = np.mean(each, axis=0)
        return field.languages[int(mean.argmax())], float(mean.max())

    found = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(frame, F.lit(False)).where("doc_id >= 1000").collect())
    wanted = sorted((k, *name(t)) for k, t, _ in asked)
    assert [x[:2] for x in found] == [x[:2] for x in wanted] and np.allclose([x[2] for x in found], [x[2] for x in wanted], atol=1e-5)
    assert {x[1] for x in found} >= {"de", "fr", "und"}


def test_texts_longer_than_a_chunk(spark):
    """Texts of over a megabyte, alone and between short ones, through every operator."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    item = say(30)
    long = f"{say(120_000)} {license_scan.TEMPLATES['GPL-3.0-or-later']} {say(60_000)} {item} {say(200)}"
    near = long.split()
    near[1000:1040] = say(40).split()
    own = {1: "short text of a few words that stays as it is", 2: long, 3: None, 4: " ".join(near), 5: say(60), 6: say(130_000) + " und der Wald", 7: ""}
    assert len(long.encode()) > 1 << 20
    docs = spark.createDataFrame([(k, t, "en") for k, t in own.items()], "doc_id long, text string, lang string").coalesce(1)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    sizes = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in own.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, VOCABULARY).collect()} == sizes
    packed = packing.pack(docs, VOCABULARY).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r.doc_id: (r.n, r.d) for r in packed} == {k: (n + 1, n + 1) for k, n in sizes.items()}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {**{k: k for k in own}, 4: 2}
    assert {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()} == {(2, "GPL-3.0-or-later"), (4, "GPL-3.0-or-later")}
    items = spark.createDataFrame([(1, item), (2, say(20))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(2, 1), (4, 1)}
    gone = {r.doc_id: r for r in suffix_dedup.repeat_digest(docs).collect()}
    start = len(" ".join(near[:1000]).encode()) + 1
    end = len(" ".join(near[:1040]).encode())
    assert gone[4].n_bytes == len(own[4].encode()) and gone[4].n_spans == 2 and end - start - 20 <= gone[4].n_bytes - gone[4].n_removed <= end - start
    assert gone[6].n_removed == gone[1].n_removed == 0
    measured = {r.doc_id: (r.n_words, r.kept) for r in quality.quality_rules(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()}
    assert measured[2][0] == len(long.split()) and measured[6][0] == 130_003
    assert language_id.identify(docs, F.lit(False)).where("lang_pred = 'en'").count() == 5
    labels = spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels, F.lit(False)).count() == len(own)
    pages = spark.createDataFrame([(1, f"http://a.net/{'x' * 2_000_000}?q"), (2, f"http://{'sub.' * 300_000}example.net/en/")], "page_id long, url string")
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "example.net", "/en/")], "verdict string, host string, path string")
    judged = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in url_filter.judge_urls(pages, rules).collect()}
    assert judged == {1: ("net/", "block", 2_000_001), 2: ("example.net/en/", "allow", 4)}


def test_contaminated(spark, docs):
    items = [(1, "What makes rain fall from clouds? Gravity pulls the heavy drops down."), (2, "tiny item"), (3, None), (4, "Stone bridges last for centuries. They carry roads over rivers and need little care."), (None, "x y z")]
    own = [(1, f"noise {items[0][1]} more noise"), (2, "WHAT makes rain fall from clouds -- gravity pulls the heavy drops down!"), (3, "What makes rain fall from clouds? Nobody knows."), (4, "a tiny item here"), (5, items[3][1].replace("centuries", "ages")), (6, items[3][1]), (None, items[3][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(own, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated(frame, b).collect()) == [("1", 1), ("2", 1), ("4", 2), ("6", 4), ("None", 4)]
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(frame, b).collect()) == [3, 5]
    assert decontaminate.contaminated(frame, b.limit(0)).count() == 0 and decontaminate.contaminated(docs, b).count() == 0


def test_contaminated_by_edited_answers_and_short_sides(spark):
    rng = random.Random(8)
    say = lambda k: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(k))
    answers = {1: say(7).split(), 2: say(3).split(), 3: say(12).split()}
    items = {k: f"{say(30)}. {' '.join(a)}." for k, a in answers.items()}
    items |= {10: "Capital of Freedonia? Fredville city.", 11: f"{say(9)}? Quartz veins.", 12: "Who wrote it? " + say(9), 13: f"{say(8)}? {say(8)}"}
    own, wanted = [], set()

    def add(text, *found):
        own.append((len(own), f"{say(20)} {text} {say(20)}"))
        wanted.update((len(own) - 1, i) for i in found)

    for k, answer in answers.items():  # each word of the answer, changed alone
        for p, word in enumerate(answer):
            add(items[k].replace(word, "changed"), k)
    add("Capital of Freedonia? Answer: Fredville, the city.", 10)
    add("Capital of Freedonia? Nobody knows the city.")
    add(items[11].replace("? ", f"? {say(30)} Answer: "), 11)
    add(items[11].replace("Quartz", "Granite"))
    add(items[12].replace("? ", "? Answer: "), 12)
    add(items[12].replace("Who wrote", "Somebody sang"))
    add(items[13].replace("? ", f"? {say(25)} "), 13)
    add(items[13].split("? ")[0])
    frame = spark.createDataFrame(own, "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, b).collect()} == wanted
    assert {r.doc_id for r in decontaminate.without_contaminated(frame, b).collect()} == {k for k, _ in own} - {k for k, _ in wanted}


def test_url_rules(spark):
    urls = ["http://a.example.net/en/1", "http://example.net/de/", "HTTP://EXAMPLE.COM/de/x?y", "ftp://x.org/fr/", "no scheme", None, "http://net", "http://net/", "http://inet/", "http://b.net?x=/en/", "https://x.example.net#/en/", "http://example.net:80/en/", "://org/fr/z", "", "http:///en/"]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/"), ("block", None, "/")]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls * 3)] + [(None, urls[0], "z")], "page_id long, url string, key string")
    given = spark.createDataFrame(rules, "verdict string, host string, path string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    for ranges in (1, 7):
        found = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_filter.judge_urls(pages, given, ranges=ranges).collect())
        wanted = sorted((str(i), *[str(x) if k == 2 else x for k, x in enumerate(judge(u))]) for i, u in [*enumerate(urls * 3), (None, urls[0])])
        assert found == wanted


def test_licenses(spark, docs):
    own = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "licensed under apache"), (3, None), (4, "Licensed under the Apache License, Version 2.0. " * 3), (5, license_scan.TEMPLATES["MIT"].replace("free of charge", "gratis"))]
    found = [(r.doc_id, r.license, round(r.coverage, 2)) for r in license_scan.scan_licenses(spark.createDataFrame(own, "doc_id long, text string")).collect()]
    assert sorted(found) == [(1, "Apache-2.0", 1.0), (4, "Apache-2.0", 1.0), (4, "Apache-2.0", 1.0), (4, "Apache-2.0", 1.0), (5, "MIT", 0.95)]
    assert license_scan.scan_licenses(docs).count() == 0


@pytest.mark.parametrize("name", ["BSD-3-Clause", "GPL-3.0-or-later", "Apache-2.0", "MIT"])
def test_each_copy_of_a_license_is_found(name):
    """Copies behind filler, close to each other or apart, whole or with a word changed or put in: a place for each."""
    templates = license_scan.Templates({name: license_scan.TEMPLATES[name]})
    size = len(templates.words[0])
    hashed = lambda text: license_scan.term_hashes(raw := np.frombuffer(text.encode(), np.uint8), np.array([0, len(raw)]))[0]
    assert (hashed(license_scan.TEMPLATES[name]) == templates.words[0]).all()
    rng = random.Random(2)
    for gap in (0, 1, 3, size // 2, size, 2 * size, 5 * size):
        for edit in ("none", "changed", "longer"):
            text, wanted = [f"f{k}" for k in range(40)], []
            for k in range(20):
                copy = re.findall(r"[a-z0-9]+", license_scan.TEMPLATES[name].lower())
                p = rng.randint(1, size - 2)
                if edit != "none":
                    copy[p : p + (edit == "changed")] = [f"e{k}"]
                wanted.append((len(text), len(text) + len(copy)))
                text += [*copy, *(f"g{k}x{j}" for j in range(gap))]
            found = templates.scan(hashed(" ".join(text)), 0.8)
            assert [x[2:] for x in found] == wanted, (gap, edit)
            assert all(x[1] == (size - (edit == "changed")) / size for x in found)
    spread = [x for k, w in enumerate(re.findall(r"[a-z0-9]+", license_scan.TEMPLATES[name].lower())) for x in (w, f"s{k}")]
    assert [x[1:] for x in templates.scan(hashed(" ".join(["before"] * 9 + spread)), 0.8)] == [(1.0, 9, 9 + 2 * size - 1)]


def test_toxicity_and_language_on_odd_rows(docs, labels):
    scored = toxicity.toxicity(docs, labels, F.col("doc_id") % 5 == 0).collect()
    assert len(scored) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    named = language_id.identify(docs, F.col("doc_id") % 3 == 1).collect()
    assert len(named) == len(rows())
    text = {r[0]: r[1] for r in rows()}
    for r in named:
        if r.doc_id in (0, 1, 2):
            assert (r.lang_pred, r.score) == ("und", 0.0) and not re.search(r"[^\W\d_]", text[r.doc_id] or "")


def test_held_out_accuracy(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    named = language_id.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    good = named.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert good > 0.97
    scored = toxicity.toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).where("held_out").join(labels, "doc_id")
    assert scored.where("predicted = toxic").count() > 0.9 * scored.count()


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    items = spark.createDataFrame([(1, "some text of an item to find")], "item_id long, text string")
    rules = spark.createDataFrame([("block", "net", "/")], "verdict string, host string, path string")
    out = [
        packing.pack(none, VOCABULARY), minhash.near_duplicates(none), toxicity.toxicity(none, no_labels, F.lit(False)), toxicity.toxicity(none, labels, F.lit(False)),
        url_filter.judge_urls(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), rules), suffix_dedup.repeat_digest(none),
        quality.quality_rules(none, labels), token_counts.count_tokens(none, VOCABULARY), license_scan.scan_licenses(none),
        decontaminate.contaminated(none, items), language_id.identify(none, F.lit(False)),
    ]
    assert [df.count() for df in out] == [0] * len(out)
    assert quality.quality_rules(docs, no_labels).count() == len(rows()) and toxicity.toxicity(docs, no_labels, F.lit(False)).count() == len(rows())
    assert url_filter.judge_urls(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), rules.limit(0)).where("verdict = 'allow'").count() == len(rows())


@pytest.mark.parametrize("name", ["op3_toxicity", "op8_license_scans"])
def test_queries_run(spark, data, name):
    found = QUERIES[name](spark, data).count()
    assert found == spark.read.parquet(f"{data}/documents.parquet").count() if name == "op3_toxicity" else found > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = QUERIES[name](spark, data)
    wanted = con.sql(f"select {', '.join(found.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
