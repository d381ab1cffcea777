"""Phrase mining and exact dedup against brute force on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone.llm import components, exact_dedup, phrase_mining
from loamstone.llm.io import met, saved

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n long, f long, phrase string, row long, name string, kept string"


def documents(seed=5):
    rng = random.Random(seed)
    words = "New York über City\x00 of the a Rain é niño big".split(" ")
    texts = [None, "", " \t ", ".;!", "a", "A", "a b c d e f g h " * 40, "x " * 200, "the big apple, the Big Apple. " * 50]
    for _ in range(150):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", " "]) for _ in range(rng.randint(0, 60))))
    texts += [texts[20]] * 70 + [texts[21].upper() for _ in range(3)]
    out = [(k, t, [None, "en", "de", "und", ""][k % 5], k, 1, "p", 2, "n", "k") for k, t in enumerate(texts)]
    return [*out, out[20], out[20], (None, texts[20], "en", *out[0][3:]), (None, None, None, *out[0][3:])]


def expected_phrases(rows, least, top, covered=80):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            lang = lang if lang is not None else "und"
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            holders = [b for (g, q), b in f.items() if g == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= covered * a for b in holders):
                found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


@pytest.mark.parametrize("sizes", [(1 << 24, 1 << 24), (2000, 500)])
def test_collocations(spark, monkeypatch, sizes):
    monkeypatch.setattr(phrase_mining, "SHARD_BYTES", sizes[0])  # many shards and ranges, whose borders cut phrases
    monkeypatch.setattr(phrase_mining, "RANGE_BYTES", sizes[1])
    monkeypatch.setattr(phrase_mining, "SAMPLE_WORDS", 20)
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")
    for least, top in ((5, 40), (2, None)):
        found = phrase_mining.collocations(df, least=least, top=top).collect()
        wanted = expected_phrases(rows, least, top)
        assert sorted(map(tuple, found)) == wanted and len(wanted) > 20
    assert phrase_mining.collocations(df.limit(0)).count() == 0


def test_automaton_holds_its_paths():
    rng = np.random.default_rng(0)
    for size in (1, 7, 3000):
        table = np.unique(rng.integers(0, 6, (size, 5)), axis=0)
        columns, weights = [table[:, k] for k in range(5)], rng.integers(1, 4, len(table))
        data = phrase_mining.automaton(columns, weights)
        back, w = phrase_mining.paths(data)
        assert all((a == b).all() for a, b in zip(columns, back)) and (w == weights).all()
    every = np.array(np.meshgrid(*[range(5)] * 5, indexing="ij")).reshape(5, -1)
    assert len(phrase_mining.automaton(list(every), np.ones(every.shape[1], int))) < 300  # equal states are kept once


@pytest.mark.parametrize("bits", [exact_dedup.FILTER_BITS, 1])
def test_exact_duplicates(spark, bits):
    rows = documents()
    rows += [(1000 + k, f"row {k % 14900}", *rows[0][2:]) for k in range(15000)]  # of several blocks: with few bits, several passes
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = [tuple(r) for r in exact_dedup.exact_duplicates(df, filter_bits=bits).collect()]
    groups = {}
    for k, (i, text, *_) in enumerate(rows):
        groups.setdefault((text or "").translate(LOWER), []).append((-1 if i is None else i, -k, i))
    wanted = []
    for text, own in groups.items():
        best = max(own, key=lambda x: x[:2])
        wanted += [(i, best[2], len(own), (j, k, i) == best, hashlib.sha256(text.encode()).hexdigest()) for j, k, i in own]
    order = lambda xs: sorted(xs, key=str)
    assert order(found) == order(wanted)
    kept = exact_dedup.without_copies(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert order(r.doc_id for r in kept.collect()) == order(w[0] for w in wanted if w[3])
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_only_repeated_names_are_kept_back(spark):
    names = saved(spark.range(30000).select(F.xxhash64(F.when(F.col("id") < 500, F.col("id") % 100).otherwise(F.col("id"))).alias("name"), "id"))
    rows = exact_dedup.possibly_repeated(names, 30000).where("maybe").select("id").collect()
    ids = {r.id for r in rows}
    assert set(range(500)) <= ids and len(ids) < 500 + 0.04 * 30000


def test_hot_keys_stay_where_they_are(spark):
    rows = saved(spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("key"), "id"))
    groups = saved(rows.groupBy("key").agg(F.count("*").alias("size")).where("key <> 3500"))
    assert met(rows, groups, ["key"], 4000, "size").count() == 3999
    left = met(rows, groups, ["key"], 4000, "size", "left")
    assert left.count() == 4000 and left.where("size is null").count() == 1


def test_plans_of_components_stay_small(spark, monkeypatch):
    """A plan of both stars named its edges hundreds of times, and the driver kept such plans for each of their stages."""
    sizes = []

    def counted(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation "))
        return saved(df)

    monkeypatch.setattr(components, "saved", counted)
    chain = spark.range(1, 300).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    found = components.components(chain).collect()
    assert sorted(r.id for r in found) == list(range(300)) and {r.component for r in found} == {0}
    assert len(sizes) > 2 and max(sizes) <= 20, sizes
