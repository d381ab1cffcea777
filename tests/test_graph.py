"""Graph operators that run in rounds or fold groups, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loamstone.operators import graph as G

EDGES = "id string, kind string, src long, dst long, weight double"


def graph(seed, n=150, m=500):
    rng = random.Random(seed)
    edges = []
    for k in range(m):
        a, b = rng.randrange(n), min(n - 1, int(rng.paretovariate(0.7)))  # some nodes are known to most
        edges.append((f"e{k}", rng.choice(["fact", "co_occurrence", "chat", "episode"]), *(rng.sample([a, b], 2)), rng.choice([0.1, 0.5, 0.9])))
    return [(k, float(rng.randint(0, 12))) for k in range(n)], edges


def plain_view(nodes, edges, limit, shown=()):
    act = dict(nodes)
    ways = [(s, d) for _, kind, s, d, _ in edges if s != d and s in act and d in act]
    ways += [(d, s) for _, kind, s, d, _ in edges if kind in G.SYMMETRIC and s != d and s in act and d in act]
    order = lambda xs: sorted(xs, key=lambda i: (-act[i], i))
    view = list(dict.fromkeys([*order(shown)[:limit], *order(act)[: max(1, int(limit / 3))]]))[:limit]
    while len(view) < limit:
        near = {d for s, d in ways if s in view and d not in view}
        if not near:
            break
        view.append(min(near, key=lambda i: (-sum(s == i and d in view for s, d in ways), -act[i], i)))
    return view


@pytest.mark.parametrize("tried", [8, 0])
def test_view_grows_by_walks_into_what_is_kept(spark, monkeypatch, tried):
    monkeypatch.setattr(G, "TRIED", tried)
    for seed, limit, shown in ((1, 30, ()), (2, 45, (3, 77, 140)), (3, 140, ())):
        nodes, edges = graph(seed, m=500 if seed < 3 else 90)
        retrieved = spark.createDataFrame([(i,) for i in (*shown, 9999)], "id long") if shown else None
        found = G.grown_view(spark.createDataFrame(nodes, "id long, activation double"), spark.createDataFrame(edges, EDGES), limit, retrieved=retrieved).orderBy("position").collect()
        assert [r.id for r in found] == plain_view(nodes, edges, limit, shown)
        assert all(r.retrieved == (not shown or r.id in shown) for r in found) and {0.0, 1.0} <= {r.activation_norm for r in found}


def test_view_is_checked_beyond_the_pool(spark, monkeypatch):
    """A node that no seed makes promising is pulled in by nodes that came."""
    monkeypatch.setattr(G, "TRIED", 0)
    nodes = [(0, 9.0), *[(k, 5.0) for k in range(1, 40)], (100, 0.0)]
    edges = [(f"a{k}", "chat", 0, k, 0.1) for k in range(1, 40)] + [("z", "chat", 0, 100, 0.1)] + [(f"b{k}{j}", "chat", k, 100, 0.1) for k in (1, 2) for j in (0, 1)]
    found = G.grown_view(spark.createDataFrame(nodes, "id long, activation double"), spark.createDataFrame(edges, EDGES), 5, share=0.2)
    assert [r.id for r in found.orderBy("position").collect()] == plain_view(nodes, edges, 5)[:5]


def test_view_edges(spark):
    view = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "id long, retrieved boolean")
    edges = spark.createDataFrame([("a", "fact", 1, 3, 0.9), ("b", "fact", 1, 2, 0.1), ("c", "chat", 3, 4, 1.0), ("d", "fact", 1, 9, 1.0), ("e", "fact", 2, 1, -0.5)], EDGES)
    assert [r.id for r in G.view_edges(view, edges, 3).collect()] == ["e", "b", "a"]


def test_a_chat_of_100_000_nodes_spreads_without_its_pairs(spark):
    nodes = spark.range(100_000).selectExpr("id", "'fact' as kind", "1 as chat_id", "1.0 as strength")
    none = spark.createDataFrame([], "src long, dst long, strength double")
    seeds = spark.createDataFrame([(7, 1.0)], "id long, activation double")
    found = G.spread(none, seeds, hops=1, cliques=G.chat_cliques(nodes)).where("id in (7, 8, 99999)").collect()
    share = 0.35 * 0.1 / 99_999
    assert {r.id: round(r.activation / (1 if r.id == 7 else share), 9) for r in found} == {7: 1.0, 8: 1.0, 99999: 1.0}


def test_members_share_one_spread(spark):
    ways = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.0), (1, 3, 0.25)], "src long, dst long, strength double")
    seeds = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0)], "group string, id long, activation double")
    members = spark.createDataFrame([("a", "x", 2, 0.5), ("a", "y", 9, 0.5), ("b", "x", 2, 0.5)], "group string, member string, id long, activation double")
    found = {(r.group, r.member, r.id): r.activation for r in G.spread_for_members(ways, seeds, members).collect()}
    for group, member in (("a", "x"), ("a", "y"), ("b", "x")):
        both = seeds.where(F.col("group") == group).select("id", "activation").unionByName(members.where((F.col("group") == group) & (F.col("member") == member)).select("id", "activation"))
        for r in G.spread(ways, both).collect():
            assert abs(found.pop((group, member, r.id)) - r.activation) < 1e-12
    assert not found
    with pytest.raises(ValueError):
        G.spread_for_members(ways, seeds.withColumn("activation", -F.col("activation")), members)


def test_mentions_by_a_dictionary(spark):
    labels = [("p1", " Ann Lee "), ("p1", "annie"), ("p2", "Lee"), ("p3", "C++ dev"), ("p4", "al"), ("p5", "***"), ("p6", "O'Neil-Smith"), ("p7", r"a\E.*b"), ("p8", None), ("p9", "é_1"), ("p10", "lee, jr.")]
    texts = [(1, "I met ann lee."), (2, "ANN  LEE and Annie"), (3, "leeward_lee lee2"), (4, "A C++ dev; a c dev"), (5, "al *** al"), (6, "o'neil-smith's"), (7, r"xa\E.*b a\e.*b"), (8, None), (9, "é_1 é_12"), (10, "Lee, Jr. came"), (11, "")]
    found = G.mentioned(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(labels, "node string, label string"))
    assert sorted((r.id, r.node) for r in found.collect()) == [(1, "p1"), (1, "p2"), (2, "p1"), (2, "p2"), (4, "p3"), (6, "p6"), (7, "p7"), (9, "p9"), (10, "p10"), (10, "p2")]
    assert G.mentioned(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "node string, label string")).count() == 0


def test_projection_keeps_telemetry(spark):
    schema = "id string, kind string, text string, owners array<string>, recall_count long, character_scoped boolean"
    old = spark.createDataFrame([("a", "fact", "x", ["u"], 5, True), ("b", "fact", "y", None, 2, None), ("c", "fact", "z", ["u"], 1, False)], schema)
    new = spark.createDataFrame([("a", "fact", "X", ["v", "u"], 0, False), ("b", "episode", "Y", ["w"], 0, False), ("n", "fact", "N", None, 0, True)], schema)
    found = {r.id: tuple(r)[1:] for r in G.projected_upsert(old, new).collect()}
    assert found == {"a": ("fact", "X", ["u", "v"], 5, True), "b": ("episode", "Y", ["w"], 0, False), "c": ("fact", "z", ["u"], 1, False), "n": ("fact", "N", None, 0, True)}


def test_spreading_writes_what_it_reaches(spark, monkeypatch):
    """With nodes the result is that of all weighted walks, but only walks out of the fronts are written; a view shuffles no walks of nodes outside."""
    from loamstone.operators import graph as G

    walks = spark.range(3000).select(F.concat(F.lit("n"), (F.col("id") % 500).cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("id") * 7 % 600).cast("string")).alias("dst"), (F.col("id") % 5 / 10 + 0.1).alias("strength"))
    nodes = spark.range(550).where("id % 9 <> 4").select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), (F.col("id") % 3 / 3 + 0.2).alias("strength"))
    seeds = spark.createDataFrame([("a", "n1", 0.8), ("a", "n4", 0.5), ("b", "n1", 0.3), ("b", "n2", -1.0), ("b", "x", 1.0)], "team string, id string, activation double")
    sizes = []
    keep = G.saved
    monkeypatch.setattr(G, "saved", lambda df: (out := keep(df), sizes.append(out.count()))[0])
    rows = lambda df: sorted((r.team, r.id, round(r.activation, 9)) for r in df.collect())
    for hops in (1, 2):
        whole = rows(G.spread(G.weighted_walks(walks, nodes), seeds, per=["team"], hops=hops))
        sizes.clear()
        assert rows(G.spread(walks, seeds, per=["team"], hops=hops, nodes=nodes)) == whole and len(whole) > 5
        assert max(sizes) < 500
    edges = walks.select("src", "dst", F.lit("episode").alias("kind"))
    view = G.grown_view(nodes.select("id", F.col("strength").alias("activation")), edges, 20)
    assert {r.id for r in view.collect()} <= {r.id for r in nodes.collect()} and view.count() == 20


@pytest.mark.parametrize("pairs, cell", [(1_000_000, 4_000_000), (40, 50)])
def test_pairs_are_dealt_over_tasks_by_their_number(spark, monkeypatch, pairs, cell):
    monkeypatch.setattr(G, "PAIRS", pairs)
    monkeypatch.setattr(G, "CELL", cell)
    rng = random.Random(5)
    rows = [(rng.randrange(60), None if k % 50 == 0 else rng.randrange(40)) for k in range(300)] + [(k, 77) for k in range(45)]  # one key that many share
    found = G.shared_pairs(spark.createDataFrame(rows, "node long, participant long"))
    of = {}
    for node, key in rows:
        if key is not None:
            of.setdefault(key, set()).add(node)
    every = [(a, b) for nodes in of.values() for a in nodes for b in nodes if a < b]
    assert sorted(map(tuple, found.collect())) == sorted(set(every))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    tasks = {int(n) for n in re.findall(r"RepartitionByExpression.*, (\d+)", plan)}
    assert tasks == {-(-len(every) // pairs)}
    assert G.shared_pairs(spark.createDataFrame([(1, 1)], "node long, participant long")).collect() == []
