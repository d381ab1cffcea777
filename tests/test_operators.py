"""Formulas against worked values, and operators on rows at the edges."""

import math
import random
import re
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone.functions import chunking, temporal
from loamstone.functions import scoring as S
from loamstone.functions import text as T
from loamstone.operators import calendar as C
from loamstone.operators import conversation as V
from loamstone.operators import dedup as E
from loamstone.operators import graph as G
from loamstone.operators import recall as R
from loamstone.operators import retrieval as X
from loamstone.operators import tables as B
from loamstone.sources import files
from loamstone.streaming import ingest as I

DAY = 86_400.0


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("column", "wanted"),
    [
        (lambda: S.decay_score(F.lit(0.8), F.lit(10), F.lit(3 * DAY), 3 * DAY), 0.334304),
        (lambda: S.decay_score(F.lit(0.8), F.lit(10), F.lit(3 * DAY), 3 * DAY, F.lit(0.5)), 0.676101),
        (lambda: S.repaired_score(F.lit(1.0), F.lit(0.4), F.lit(1.0)), 1.06),
        (lambda: S.repaired_score(F.lit(1.0), F.lit(0.4), F.lit(0.5)), 0.73),
        (lambda: S.either(F.lit(0.5), F.lit(0.9)), 0.95),
        (lambda: S.node_strength(F.lit(0.8), F.lit(0.6)), 0.68),
        (lambda: S.edge_strength(F.lit("fact"), F.lit(0.86), confidence=F.lit(0.6), importance=F.lit(0.8)), 0.9),
        (lambda: S.edge_strength(F.lit("chat"), F.lit(0.0)), 0.5),
        (lambda: S.base_level(10.0 + 5.0, F.lit(5.0), F.lit(10)), -1.102511),
        (lambda: S.base_level(3600.0 + 5.0, F.lit(5.0), F.lit(10)), -1.951210),
        (lambda: S.age_seconds(5.0, F.lit(9.0)), 0.0),
        (lambda: T.clip(F.lit("x")), 0.5),
        (lambda: T.clip(F.lit("7")), 1.0),
        (lambda: T.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))), 0.0),
        (lambda: T.slugify(F.lit("  Hello, Wörld! ")), "hello-w-rld"),
        (lambda: T.slugify(F.lit("!!!")), "entity"),
        (lambda: T.safe_name(F.lit("_a b-")), "ab"),
        (lambda: T.age_label(F.lit(59.0)), "just now"),
        (lambda: T.age_label(F.lit(3 * DAY)), "3 days ago"),
        (lambda: T.substring_hits(F.lit("The other the"), "THE"), 3),
        (lambda: T.mentions(F.lit("I met Anna-Lena."), F.lit("anna")), True),
        (lambda: T.mentions(F.lit("Annabel"), F.lit("anna")), False),
        (lambda: T.mentions(F.lit("an al"), F.lit("al")), False),
    ],
)
def test_formula(spark, column, wanted):
    found = value(spark, column())
    assert found == pytest.approx(wanted, abs=1e-6) if isinstance(wanted, float) else found == wanted


def test_fusion(spark):
    q = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0)], "query_id int, sub_ix int, weight double")
    hit = "query_id int, sub_ix int, id string, score double, rank int"
    both = X.fused(spark.createDataFrame([(1, 0, "a", 2.0, 0), (1, 0, "b", 1.0, 1)], hit), spark.createDataFrame([(1, 0, "a", 0.8, 0), (1, 1, "c", 0.9, 0)], hit), q)
    found = {r.id: (round(r.score, 6), round(r.confidence, 6), round(r.relevance, 6)) for r in both.collect()}
    assert found == {"a": (0.032787, 1.0, 1.0), "b": (round(1 / 62, 6), 0.5, round(61 / 124, 6))}


def test_hybrid_filters_before_the_cut(spark):
    docs = spark.createDataFrame([(k, "rare word" if k == 99 else "common word", "de" if k == 99 else "en") for k in range(100)], "id long, text string, lang string")
    vectors = docs.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    q = spark.createDataFrame([(1, 0, "word", 1.0, [0.0, 1.0]), (1, 1, " ", 1.0, None)], "query_id int, sub_ix int, text string, weight double, vec array<double>")
    assert [r.id for r in X.hybrid(docs, vectors, q, 5, where=F.col("lang") == "de", floor=0.0).collect()] == [99]
    assert [r.id for r in X.hybrid(docs, vectors, q, 5, allowed=docs.where("id = 7")).collect()] == [7]


def test_sticky_slots(spark):
    schema = "id long, score double, combined double, temporal double, semantic double, effective double, is_sticky boolean"
    row = lambda i, s, sticky: (i, s, s, 0.0, s, s, sticky)
    two = spark.createDataFrame([row(1, 0.9, True), row(2, 0.8, True), row(3, 0.1, False)], schema)
    assert sorted(r.id for r in R.sticky_top(two, 4).collect()) == [1, 3]
    assert [r.id for r in R.sticky_top(two, 1).collect()] == [1]
    assert sorted(r.id for r in R.sticky_top(spark.createDataFrame([row(k, k / 10, False) for k in range(5)], schema), 3).collect()) == [2, 3, 4]


def test_budgets(spark):
    items = spark.createDataFrame([("g", k, t) for k, t in enumerate([30, 90, 40, 20])], "g string, pos int, tokens int")
    assert [r.pos for r in R.budget_prefix(items, 100, [F.asc("pos")]).collect()] == [0]
    assert sorted(r.pos for r in R.budget_greedy(items, 100, "g", "pos").collect()) == [0, 2, 3]
    assert {r.pos: r.batch for r in X.batches_by_limits(items, "g", "pos", "tokens", 2, 80).collect()} == {0: 0, 1: 1, 2: 2, 3: 2}


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, v string, w string")
    assert [r.id for r in B.scan(t, {"w": None}).collect()] == [1]
    assert sorted(map(tuple, B.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")).collect())) == [(1, "a", None), (2, "c", "x"), (3, "d", None)]
    assert B.delete_where(t, w=None).count() == 2
    with pytest.raises(ValueError):
        B.delete_where(t)
    touching = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (5.0, 6.0)], "start double, end double")
    assert sorted(map(tuple, B.interval_union(touching).collect())) == [(1.0, 3.0), (5.0, 6.0)]
    assert [r.id for r in B.by_ids(t, [2, 9, 1]).collect()] == [2, 1]
    new = spark.createDataFrame([(5, "u", " A "), (6, "u", "a"), (7, "u", " "), (8, "v", "b")], "id long, user_id string, content string")
    assert [r.id for r in B.new_texts(new, spark.createDataFrame([("v", "B")], "user_id string, content string")).collect()] == [5]


def test_rounds_with_a_leading_reply(spark):
    m = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 2, "user", "a"), (1, 3, "assistant", "b"), (1, 4, "user", "c")], "chat_id int, id int, role string, content string")
    assert [(r["round"], r.content) for r in V.rounds(m).orderBy("round").collect()] == [(0, "hi"), (1, "a\nb"), (2, "c")]


def test_spread(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9)], "src string, dst string, strength double")
    seeds = spark.createDataFrame([("a", 1.0)], "id string, activation double")
    assert {r.id: round(r.activation, 6) for r in G.spread(edges, seeds, hops=0).collect()} == {"a": 1.0, "b": round(0.35 * 0.9 / 2, 6), "c": round(0.35 * 0.9 / 2, 6)}
    # the strength of the node that is reached counts, and a node that is not there is not reached
    nodes = spark.createDataFrame([("a", 0.4), ("b", 0.68), ("d", 1.0)], "id string, strength double")
    two = edges.unionByName(spark.createDataFrame([("a", "d", 0.5)], edges.schema))
    found = {r.id: r.activation for r in G.spread(G.weighted_walks(two, nodes), seeds, hops=1).collect()}
    assert {k: round(v, 6) for k, v in found.items()} == {"a": 1.0, "b": round(0.35 * 0.9 * 0.68 / 2, 6), "d": round(0.35 * 0.5 / 2, 6)}


def test_base_level_of_odd_times(spark):
    rows = spark.createDataFrame([(1, 100.0), (2, 0.0), (3, None), (4, 900.0)], "id int, created double")
    found = {r.id: r.b for r in rows.select("id", S.base_level(100.0, F.col("created"), F.lit(0)).alias("b")).collect()}
    # now and the future count as a thousandth of a second ago
    young = -0.5 * math.log(1e-3) - 1e-3 / (14 * DAY)
    assert abs(found[1] - young) < 1e-9 and abs(found[4] - young) < 1e-9 and found[2] == found[3] == -2.0


def swept(rows, threshold):
    """The sweep in plain Python: {id: (survivor, similarity)}."""
    unit = lambda v: [x / n for x in v] if (n := math.sqrt(sum(y * y for y in v))) else v
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    first, equal, led, wanted, kept = {}, {}, [], {}, {}
    for i, u, t, text, v in order:
        if text:
            first.setdefault((u, text), i)
    for i, u, t, text, v in order:
        if text and first[u, text] != i:
            led.append((i, first[u, text]))
        elif any(v):
            equal.setdefault((u, tuple(unit(v))), i)
    for i, u, t, text, v in order:
        v = unit(v)
        if text and first[u, text] != i or not any(v):
            continue
        if equal[u, tuple(v)] != i:
            led.insert(0, (i, equal[u, tuple(v)]))
            continue
        near = [(round(sum(a * b for a, b in zip(v, w)), 12), -n, j) for n, (j, w) in enumerate(kept.setdefault(u, []))]
        if near and max(near)[0] >= threshold:
            wanted[i] = (max(near)[2], max(near)[0])
        else:
            kept[u].append((i, v))
    for i, head in led:  # copies of vectors before those of texts
        wanted[i] = wanted.get(head, (head, 1.0))
    return {k: (s, round(x, 9)) for k, (s, x) in wanted.items()}


@pytest.mark.parametrize("small", [E.SMALL, 20])
def test_sweep_is_greedy(spark, small):
    """Rows near a dropped row only stay; copies go the way of the first; against plain Python on random rows, as whole scopes and by keys of hyperplanes."""
    rng = random.Random(3)
    rows = []
    for k in range(260):
        v = [rng.gauss(0, 1) for _ in range(3)] if k % 5 else rows[k // 2][4] if k else [1.0, 0.0, 0.0]
        rows.append((k, f"u{k % 3}", float(rng.randint(0, 40)), rng.choice(["", f"text {rng.randint(0, 90)}"]), v if k % 17 else [0.0, 0.0, 0.0]))
    frame = spark.createDataFrame(rows, "id long, user_id string, created_at double, content string, vec array<double>")
    found = {r.id: (r.survivor, round(r.similarity, 9)) for r in E.greedy_sweep(frame, threshold=0.95, small=small).collect()}
    assert found == swept(rows, 0.95) and len(found) > 60


def test_sweep_over_a_long_chain(spark):
    """10,000 rows, each like the one before and the one after only."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=64)
    rows = []
    for k in range(10_000):
        v = v / np.linalg.norm(v)
        step = rng.normal(size=64)
        step -= (step @ v) * v
        v = v + 0.36 * step / np.linalg.norm(step)  # a cosine of 0.94 to the next, of 0.885 to the one after it
        rows.append((k, "u", float(k), "", v.tolist()))
    frame = spark.createDataFrame(rows, "id long, user_id string, created_at double, content string, vec array<double>")
    found = {r.id: r.survivor for r in E.greedy_sweep(frame, threshold=0.92).collect()}
    units = np.array([r[4] for r in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    kept, wanted = [], {}
    for k in range(10_000):
        scores = units[kept] @ units[k] if kept else np.zeros(0)
        if len(scores) and scores.max() >= 0.92:
            wanted[k] = kept[int(scores.argmax())]
        else:
            kept.append(k)
    assert found == wanted and len(found) > 4000


def test_keys_find_pairs_at_the_threshold():
    bits, tables, cost = E.bands(100_000, 0.92)
    assert cost < 1000 and E.bands(5_000, 0.25)[2] > 5_000  # at a low threshold keys are dearer than all pairs
    same = 1 - math.acos(0.92) / math.pi
    assert (1 - same**bits) ** tables <= 1e-6 and 2**bits > 20_000


def test_markdown_and_turns():

    text = "before\n\n# Head\n\n## Empty\n\n## One\n\n" + "a b c d e f g. " * 40 + "\n\ntiny\n\n## Two\n\nshort"
    assert [t for t, _ in chunking.sections(text)] == ["", "One", "Two"]
    found = chunking.markdown(text, most=60, least=10)
    assert [t for t, _ in found].count("Two") == 1 and found[-1] == ("Two", "# Two\n\nshort")  # a tiny section does not join another one
    assert all(c.startswith("# One") for t, c in found if t == "One") and found[0] == ("", "before")
    assert chunking.merged(["tiny", "long enough to stay by itself, really", "x"], least=5) == ["tiny\n\nlong enough to stay by itself, really\n\nx"]
    assert chunking.merged(["only"], least=5) == ["only"] and chunking.merged([], least=5) == []
    said = chunking.turns("prologue\n\nAnna-Lena: hi\nthere\n\nno speaker: (really)?\nmore\n\n<b>: not one\n\nBob?: \n\n")
    assert said == [("Anna-Lena", "hi\nthere"), ("no speaker", "(really)?\nmore\n<b>: not one"), ("Bob?", "")]


def test_times_in_texts():
    now = datetime(2024, 1, 31, 12, tzinfo=timezone.utc)
    at = lambda *x: datetime(*x, tzinfo=timezone.utc).timestamp()
    cases = {
        "1.5 hours ago": [(at(2024, 1, 31, 10), at(2024, 1, 31, 11), "hour", 1.0)], "in 2 months": [(at(2024, 3, 1), at(2024, 4, 1), "month", 1.0)], "a month ago": [(at(2023, 12, 1), at(2024, 1, 1), "month", 1.0)],
        "March 5": [(at(2023, 3, 5), at(2023, 3, 6), "day", 0.9)], "on 5 January 2024": [(at(2024, 1, 1), at(2025, 1, 1), "year", 0.9)], "2024/1/5 10:30": [(at(2024, 1, 5, 10, 30), at(2024, 1, 5, 10, 31), "minute", 0.9)],
        "vor drei Tagen": [(at(2024, 1, 28), at(2024, 1, 29), "day", 1.0)], "übermorgen, nicht morgens": [(at(2024, 2, 2), at(2024, 2, 3), "day", 1.0)], "in zwei  Jahren": [(at(2026, 1, 1), at(2027, 1, 1), "year", 1.0)],
        "Il y a 2 semaines": [(at(2024, 1, 15), at(2024, 1, 22), "week", 1.0)], "avant-hier et aujourd’hui": [(at(2024, 1, 29), at(2024, 1, 30), "day", 1.0), (at(2024, 1, 31), at(2024, 2, 1), "day", 1.0)], "L'ANNÉE DERNIÈRE": [(at(2023, 1, 1), at(2024, 1, 1), "year", 1.0)],
        "hace 1,5 horas": [(at(2024, 1, 31, 10), at(2024, 1, 31, 11), "hour", 1.0)], "pasado mañana": [(at(2024, 2, 2), at(2024, 2, 3), "day", 1.0)], "dentro de una semana": [(at(2024, 2, 5), at(2024, 2, 12), "week", 1.0)], "el 3 de enero": [(at(2024, 1, 3), at(2024, 1, 4), "day", 0.9)],
        "in 99999 years": [], "vor Tagen": [], "ayer.mañana": [(at(2024, 1, 30), at(2024, 1, 31), "day", 1.0), (at(2024, 2, 1), at(2024, 2, 2), "day", 1.0)], "5. März": [(at(2023, 3, 5), at(2023, 3, 6), "day", 0.9)],
        "Feb 30": [], "2024-13-01": [], "yesterdays": [], "": [],
    }
    for text, wanted in cases.items():
        assert [r[:4] for r in temporal.resolve(text, now)] == wanted, text
        assert not wanted or re.search(temporal.last_words().replace(r"[\p{L}\p{N}_]", r"\w").replace("(?iu)", "(?i)"), text), text
    assert temporal.resolve("hier", now, languages=("de", "en")) == [] and temporal.phrases_in("in 2 minutes", ("fr", "de", "en"))[0][2:] == ("minute", 2.0, "en")


def test_searches_rank_like_plain_python(spark):
    """Top lists of dense and lexical search against all scores, in several blocks of queries, with ties, odd vectors and repeated words."""
    rng = random.Random(5)
    vectors = [(k, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for k in range(300)] + [(900, None), (901, [1.0]), (902, [0.0] * 4)]
    asked = [(k, 0, " ".join(rng.choice("abcdef") for _ in range(3)), [rng.gauss(0, 1) for _ in range(4)]) for k in range(25)] + [(99, 0, "", None), (98, 0, "zzz", [1.0])]
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for k in range(200)] + [(900, None)]
    q = spark.createDataFrame(asked, "query_id long, sub_ix int, text string, vec array<double>")
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    old, X.QUERY_BLOCK = X.QUERY_BLOCK, 7
    try:
        near = X.ranked(X.dense(v, q, pool=5).withColumn("score", F.round("score", 6)), 5).collect()
        index = X.indexed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), queries=q)
        best = X.ranked(X.bm25_top(index, q, 5).withColumn("score", F.round("score", 6)), 5).collect()
        every = X.ranked(X.bm25(index, q).withColumn("score", F.round("score", 6)), 5).collect()
    finally:
        X.QUERY_BLOCK = old
    norm = lambda x: math.sqrt(sum(y * y for y in x)) or 1.0
    wanted = set()
    for k, _, _, x in asked:
        if x and len(x) == 4:
            scores = sorted((-round(sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y), 6) + 0.0, i) for i, y in vectors if y and len(y) == 4)
            wanted |= {(k, i, n) for n, (_, i) in enumerate(scores[:5])}
    assert {(r.query_id, r.id, r.rank) for r in near if r.query_id < 98} == wanted
    assert sorted(map(tuple, best)) == sorted(map(tuple, every)) and len({r.query_id for r in best}) == 25


def test_graph_edges(spark):
    e = spark.createDataFrame([("e1", "chat", "a", "b", 0.1), ("e2", "fact", "a", "b", 0.2), ("e3", "chat", "b", "b", 0.3)], "id string, kind string, src string, dst string, weight double")
    assert G.walks(e).count() == 5
    assert sorted((r.neighbour, r.edge) for r in G.neighbours(e, spark.createDataFrame([("a",)], "id string")).collect()) == [("b", "e1"), ("b", "e2")]
    moved = G.rewired(e, spark.createDataFrame([("a", "z")], "id string, survivor string"))
    assert sorted(r.id for r in moved.collect()) == ["e:chat:b::z", "e:fact:z->b"]
    nodes = spark.createDataFrame([("p", "person", [], False), ("f", "fact", ["u"], False), ("q", "person", None, True)], "id string, kind string, owners array<string>, character_scoped boolean")
    assert [r.id for r in G.visible(nodes, ["u"]).orderBy("id").collect()] == ["f", "q"]
    owned = G.owners_from_content(nodes, spark.createDataFrame([("x", "fact", "p", "f", 1.0), ("y", "fact", "p", "q", 1.0)], e.schema))
    assert {r.id: r.owners for r in owned.collect()} == {"p": ["u"], "f": ["u"], "q": []}


def test_greedy_sweep_is_not_components(spark):
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    rows = spark.createDataFrame([(1, "u", 1.0, "a", at(0)), (2, "u", 2.0, "b", at(20)), (3, "u", 3.0, "c", at(40)), (4, "u", 4.0, " A", at(90))], "id long, user_id string, created_at double, content string, vec array<double>")
    assert sorted((r.id, r.survivor) for r in E.greedy_sweep(rows, threshold=0.92).collect()) == [(2, 1), (4, 1)]


def test_decisions(spark):
    rows = [(1, 10, "equivalent", {"equivalent": 0.99, "distinct": 0.01}), (2, 10, "corrects", {"corrects": 0.985, "distinct": 0.01}), (3, 10, "equivalent", {"equivalent": 0.98, "distinct": 0.9})]
    rows += [(4, 10, "equivalent", {"equivalent": 1.0}), (4, 11, "equivalent", {"equivalent": 1.0})]
    d = spark.createDataFrame(rows, "incoming_id long, candidate_id long, relationship string, probabilities map<string,double>")
    assert [r.incoming_id for r in E.decided(d).collect()] == [1]


def test_routines_across_midnight_and_daylight_saving(spark):
    rules = spark.createDataFrame([(1, [6], "23:00", 180, "Europe/Berlin"), (2, [0], "00:30", 30, "UTC")], "id int, weekdays array<int>, start_local string, minutes int, timezone string")
    found = C.weekly_occurrences(rules, "2024-03-31 21:30:00", "2024-04-01 12:00:00").orderBy("id")
    got = [(r.id, r.start.replace(tzinfo=None), r.end.replace(tzinfo=None)) for r in found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}).collect()]
    assert got == [(1, datetime(2024, 3, 31, 21), datetime(2024, 4, 1)), (2, datetime(2024, 4, 1, 0, 30), datetime(2024, 4, 1, 1))]


def test_points_on_half_open_bounds(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None)], "id int, occurred_at double")
    ranges = spark.createDataFrame([(10.0, 20.0, 0.5, 1.0)], "start double, end double, confidence double, query_weight double")
    assert [(r.id, r.temporal) for r in R.temporal_relevance(rows, ranges).collect()] == [(1, 0.5)]


def test_expressions():
    now = datetime(2024, 3, 31, 12, tzinfo=timezone.utc)
    day = lambda *a: datetime(*a, tzinfo=timezone.utc).timestamp()
    assert temporal.resolve("the day before yesterday and yesterday", now)[0][:2] == (day(2024, 3, 29), day(2024, 3, 30))
    assert temporal.resolve("one month ago", now)[0][:3] == (day(2024, 2, 1), day(2024, 3, 1), "month")
    assert temporal.resolve("last week", now)[0][:2] == (day(2024, 3, 18), day(2024, 3, 25))
    assert temporal.resolve("on 2024-01-05 or 2023-13-01", now)[0][2:4] == ("day", 0.9)
    assert temporal.resolve("nothing", now) == []


def test_chunks(spark):
    text = "intro\n\n# One\n\nbody " + "long words here " * 300 + "\n\n### sub\n\nx\n\n## Two\n\n" + "y " * 200
    found = chunking.markdown(text)
    assert all(len(c) / 4 <= 512 + 64 + 8 for _, c in found) and sum(c.count("long") for _, c in found) == 300
    assert chunking.turns("Ann: hello\nmore\n\nstage note\n\nBob?: hi") == [("Ann", "hello\nmore\nstage note"), ("Bob?", "hi")]
    assert chunking.chunked(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).where("id = 2").count() == 0


def test_files_and_generations(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\ntext")
    assert files.read_texts(spark, str(tmp_path / "in")).first().text == "# A\n\ntext"
    root = str(tmp_path / "index")
    for n in (3, 5):
        files.write_generation(spark.range(n), root)
    assert files.read_generation(spark, root).count() == 5
    files.write_snapshot(spark.range(2), str(tmp_path / "t"))
    spark.range(1).withColumn("extra", F.lit("x")).write.mode("append").parquet(str(tmp_path / "t"))
    assert files.read_snapshot(spark, str(tmp_path / "t")).where("extra is null").count() == 2


def test_streams(spark, tmp_path):
    folder, schema = tmp_path / "m", "chat_id long, id long, role string"
    rows = [(c, 100 * c + k, "user" if k % 2 == 0 else "assistant") for c in (1, 2) for k in range(12 if c == 1 else 4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
    found = []
    stream = I.extraction_triggers(I.message_stream(spark, str(folder), spark.createDataFrame([], schema).schema), every=3)
    query = I.foreach_batch(stream, lambda df, n: found.extend(map(tuple, df.collect())), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert sorted(found) == [(1, 104, 3), (1, 110, 3)]
    again = I.foreach_batch(stream, lambda df, n: found.extend(map(tuple, df.collect())), str(tmp_path / "c"))
    again.awaitTermination(120)
    assert len(found) == 2


def test_silent_chats_are_extracted_and_forgotten(spark, tmp_path):
    folder, schema = tmp_path / "m", "chat_id long, id long, role string, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda minute: datetime(2024, 1, 1, minute // 60, minute % 60, tzinfo=timezone.utc)
    found = []

    def arrives(*rows):
        spark.createDataFrame([(c, i, role, at(m)) for c, i, role, m in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = I.extraction_events(I.message_stream(spark, str(folder), spark.createDataFrame([], schema).schema), every=3, silence=1800)
        I.foreach_batch(stream, lambda df, n: found.extend(map(tuple, df.collect())), str(tmp_path / "c")).awaitTermination(180)
        return sorted(found)

    # each call starts the query again from its checkpoint
    first = arrives((1, 1, "user", 0), (1, 2, "assistant", 1), (1, 3, "user", 2), (2, 9, "user", 5), (3, 20, "user", 1), (3, 21, "user", 2), (3, 22, "user", 3))
    assert first == [(3, 22, 3, "turns")]
    second = arrives((1, 4, "user", 10), (2, 11, "assistant", 40), (1, 5, "user", 41))
    assert (1, 4, 3, "turns") in second
    third = arrives((4, 50, "user", 200))  # the watermark passes the silence of 1 and 2; 3 has nothing left
    third = arrives((4, 51, "user", 201), (2, 12, "user", 3))  # the last one is too late
    assert third == sorted([(3, 22, 3, "turns"), (1, 4, 3, "turns"), (1, 5, 1, "silence"), (2, 9, 1, "silence")])


def test_outbox(spark):
    q = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "key string, revision int")
    assert sorted(map(tuple, I.latest_changes(q, ["key"]).collect())) == [("a", 2), ("b", 1)]
    assert sorted(map(tuple, I.acknowledged(q, spark.createDataFrame([("a", 1)], q.schema), ["key"]).collect())) == [("a", 2), ("b", 1)]


def test_reconciliation_follows_chains(spark):
    """A chain of 3,000 corrections, a change of state, drops on what is gone, ambiguous, stale and circular decisions."""
    sure, unsure = {"p": 0.995, "q": 0.005}, {"p": 0.7, "q": 0.3}
    rows = [(k, "u", f"text {k}", float(k)) for k in range(3020)] + [(9000, "other", "x", 1.0)]
    answers = [(k, k - 1, "incoming_corrects_existing", sure) for k in range(1, 3000)]
    answers += [(3000, 2500, "state_transition", sure), (3001, 3000, "equivalent", sure), (3002, 3001, "incoming_corrects_existing", sure)]  # to the root, whatever became of the candidate
    answers += [(3004, 3003, "incoming_corrects_existing", unsure), (3006, 3005, "incoming_corrects_existing", sure), (3006, 3003, "equivalent", sure), (3007, 3008, "equivalent", sure), (3008, 3007, "distinct", sure), (3009, 9000, "equivalent", sure)]
    answers += [(3011, 3010, "equivalent", sure), (3011, 3005, "existing_corrects_incoming", sure)]
    df = spark.createDataFrame(rows, "id long, user_id string, content string, created_at double")
    frame = spark.createDataFrame([(i, c, r, {r: p["p"], "other": p["q"]}) for i, c, r, p in answers], "incoming_id long, candidate_id long, relationship string, probabilities map<string,double>")
    out, versions, deltas = E.reconciled(df, frame)
    left = {r.id: r.content for r in out.collect()}
    assert left[0] == "text 3002" and {k for k in left if k < 3003} == {0} and left[3003] == "text 3003"
    assert {k for k in left if k >= 3003} == {*range(3003, 3020), 9000} - {3011}
    assert {(r.removed_id, r.updated_id) for r in deltas.where("removed_id >= 3000").collect()} == {(3000, 0), (3001, 0), (3002, 0), (3011, 3005)}
    last = [(r.version, r.source_id, r.valid_from, r.valid_until, r.withdrawn) for r in versions.where("version >= 2999").orderBy("version").collect()]
    assert last == [(2999, 2999, 0.0, 3000.0, False), (3000, 3000, 3000.0, 3000.0, True), (3001, 3002, 3000.0, None, False)]
    stale = frame.withColumn("candidate_hash", F.lit("changed since"))
    assert E.reconciled(df, stale)[2].count() == 0


def test_decisions_on_any_row_and_in_circles(spark):
    """Without ``earlier`` a decision on a later row, or one of another scope, counts; a circle, and what leads into it, goes without versions or deltas."""
    sure = {"p": 0.995, "q": 0.005}
    df = spark.createDataFrame([(k, f"u{k % 2}", f"text {k}", float(k)) for k in range(12)], "id long, user_id string, content string, created_at double")
    answers = [(1, 8, "equivalent"), (8, 7, "incoming_corrects_existing"), (2, 3, "equivalent"), (3, 4, "incoming_corrects_existing"), (4, 2, "state_transition"), (5, 4, "equivalent"), (6, 99, "equivalent"), (9, 9, "equivalent")]
    frame = spark.createDataFrame([(i, c, r, {r: sure["p"], "other": sure["q"]}) for i, c, r in answers], "incoming_id long, candidate_id long, relationship string, probabilities map<string,double>")
    found = {r.id: (r.action, r.target) for r in E.judged_targets(df, frame, earlier=False).collect()}
    assert found == {1: ("drop", 8), 8: ("revise", 7), 2: ("drop", 3), 3: ("revise", 4), 4: ("revise", 2), 5: ("drop", 4), 6: ("unresolved", None), 9: ("drop", 9)}
    out, versions, deltas = E.reconciled(df, frame, earlier=False)
    assert {r.id: r.content for r in out.collect()} == {0: "text 0", 6: "text 6", 7: "text 8", 10: "text 10", 11: "text 11"}
    assert {(r.id, r.version, r.source_id) for r in versions.collect()} == {(7, 0, 7), (7, 1, 8)}
    assert {(r.removed_id, r.updated_id) for r in deltas.collect()} == {(1, 7), (8, 7)}


@pytest.mark.parametrize("cells", [1 << 22, 64])
def test_incoming_rows_meet_all_stored_rows_without_a_row_per_pair(spark, monkeypatch, cells):
    monkeypatch.setattr(E, "CELLS", cells)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(160, 4))
    v[40:60] = v[40]  # copies tie
    v[70] = 0
    own = [(k, None if k == 11 else int(k % 3), f"t{k}" if k % 9 else "same", None if k in (5, 6) else v[k].tolist() + [1.0] * (k in (7, 8)), k % 4 == 0) for k in range(160)]
    rows = spark.createDataFrame(own, "id long, user_id int, content string, v array<double>, new boolean")
    new, old = rows.where("new"), rows.where("not new")
    pairs = new.select("id", "user_id").join(old.select(F.col("id").alias("other"), "user_id"), "user_id").select("id", "other")
    found = [{(r.id, r.survivor, round(r.similarity, 9)) for r in E.incoming_duplicates(new, old, *how).collect()} for how in ((pairs, 0.5), (None, 0.5))]
    assert found[0] == found[1] and len(found[0]) > 20
    plans = E.incoming_duplicates(new, old, None, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plans  # no pair of vectors is a row


@pytest.mark.parametrize("terms", [None, ["a", "c", "zz"]])
def test_long_batches_are_counted_in_bounded_slices(monkeypatch, terms):
    import pyarrow as pa

    rng = random.Random(4)
    words = [None, [], *[[rng.choice("abcde") for _ in range(rng.choice((1, 3, 40)))] for _ in range(60)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words))), pa.array(words, pa.list_(pa.string()))], names=["id", "words"])
    known, seen = None if terms is None else pa.array(terms), []
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **how: (seen.append(len(x)), unique(x, **how))[1])
    rows = [r for b in X._counted(known, most=50)(iter([batch])) for r in b.to_pylist()]
    plain = [{w: (x or []).count(w) for w in sorted(set(x or [])) if terms is None or w in terms} for x in words]
    assert [(r["id"], r["length"], {h["term"]: h["tf"] for h in r["hits"]}) for r in rows] == [(k, len(x or []), p) for k, (x, p) in enumerate(zip(words, plain))]
    assert max(seen) <= 50 < sum(len(x or []) for x in words)
