"""Interval joins by cells of time against plain comparison."""

import random

from pyspark.sql import functions as F

from loamstone.operators import calendar as C
from loamstone.operators import intervals as N
from loamstone.operators import recall as R


def test_points_and_overlaps(spark):
    rng = random.Random(2)
    at = lambda: rng.choice([rng.uniform(-1e6, 1e6), float(rng.randint(-20, 20)), 1024.0, 0.0])
    points = [(k, rng.choice(["x", "y"]), rng.choice([at(), at(), None])) for k in range(200)]
    ranges = []
    for k in range(120):
        s = at()
        ranges.append((k, rng.choice(["x", "y"]), rng.choice([s, s, s, None]), rng.choice([s, s - 1, s + 0.25, s + 1, s + 1024, s + 10 ** rng.randint(0, 7), None])))
    p = spark.createDataFrame(points, "p long, who string, at double")
    r = spark.createDataFrame(ranges, "r long, who string, low double, high double")
    holds = lambda s, e, t: None not in (s, t) and s <= t and (e is None or t < e)
    found = sorted((x.p, x.r) for x in N.covered(p, r, "at", "low", "high", ["who"]).collect())
    assert found == sorted((i, j) for i, a, t in points for j, b, s, e in ranges if a == b and holds(s, e, t))
    rows = [(k, t, None if t is None else rng.choice([None, t, t + 0.5, t + 300, t + 1e5])) for k, _, t in points]
    own = spark.createDataFrame(rows, "p long, start double, until double")
    every = sorted((x.p, x.r) for x in N.overlapping(own, r.drop("who"), "start", "until", "low", "high").collect())
    wanted = [(i, j) for i, t, u in rows for j, _, s, e in ranges if None not in (t, s) and (holds(s, e, t) and s != e if u is None else t < (e if e is not None else 1e300) and u > s and (e is None or e > s))]
    assert every == sorted(wanted) and len(every) > 500


def test_many_ranges_join_on_equal_cells(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 1000 * 60.0).alias("occurred_at"))
    ranges = spark.range(2000).select((F.col("id") * 30.0).alias("start"), (F.col("id") * 30.0 + 45).alias("end"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("query_weight"))
    found = R.temporal_relevance(rows, ranges)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.count() == 20_000


def test_hot_actor_is_dealt_by_time(spark):
    routines = spark.range(20_000).select(F.lit("me").alias("actor"), (F.col("id") * 100.0).alias("start"), (F.col("id") * 100.0 + 150).alias("end"), (F.col("id") % 2).alias("priority"), F.col("id").alias("routine"))
    instants = spark.range(20_000).select(F.lit("me").alias("actor"), (F.col("id") * 100.0 + 20).alias("instant"))
    found = C.active_routine(routines, instants)
    assert found.count() == 20_000
    assert all(r.routine == (k if k % 2 or k == 0 else k - 1) for r in found.where("instant < 2000").collect() for k in [int(r.instant // 100)])


def test_no_ranges(spark):
    none = spark.createDataFrame([], "start double, end double, confidence double, query_weight double")
    rows = spark.createDataFrame([(1, 5.0)], "id long, occurred_at double")
    assert R.temporal_relevance(rows, none).count() == 0


def test_many_ranges_over_a_moment_are_few_in_the_join(spark):
    """Overlapping ranges of one worth fuse, touching ones do not; empty and reversed rows find what they found range by range."""
    rng = random.Random(5)
    ranges = [(k % 3, float(s), s + rng.choice([1.0, 2.0, 7.0, 40.0, 900.0]), rng.choice([0.5, 0.9]), 1.0) for k in range(600) for s in [rng.randint(-300, 600)]] + [(7, 0.0, 5.0, 0.5, 1.0), (7, 5.0, 9.0, 0.5, 1.0), (7, 50.0, None, 0.7, 1.0)]
    rows = [(k, float(t), rng.choice([None, t + 0.0, t + 0.5, t + 30.0, t - 3.0])) for k in range(300) for t in [rng.randint(-320, 700)]] + [(400, 5.0, 5.0), (401, 5.0, None), (402, 6.0, 4.0), (403, 3.0, 1.0)]
    r = spark.createDataFrame(ranges, "query long, start double, end double, confidence double, query_weight double")
    own = spark.createDataFrame(rows, "id long, occurred_at double, until double")
    found = {(x.query, x.id): x.temporal for x in R.temporal_relevance(own, r, end="until", per=["query"]).collect()}
    wanted = {}
    for q, s, e, worth, _ in ranges:
        e = 1e300 if e is None else e
        for i, a, z in rows:
            if s <= a < e if z is None else (a < e and z > s and (z > a or s <= a)):
                wanted[q, i] = max(wanted.get((q, i), 0.0), worth)
    assert found == wanted and (7, 400) not in found and (7, 401) in found and (7, 402) not in found and (7, 403) in found
    many = spark.range(20_000).select((F.col("id") % 2).alias("q"), (F.col("id") * 0.7).alias("start"), (F.col("id") * 0.7 + 600).alias("end"))
    assert N.fused(many, "start", "end", ["q"]).count() <= 6
