"""Search over inverted lists against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone.operators import retrieval as X
from loamstone.operators import vectors as N


def best(found, k):
    out = {}
    for r in X.ranked(found.withColumn("score", F.round("score", 6)), k).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    return {q: [x[1:] for x in sorted(own)] for q, own in out.items()}


def plain(ids, v, queries, k):
    units = lambda x: x / np.where((n := np.linalg.norm(x, axis=-1, keepdims=True)) > 0, n, 1)
    scores = np.round(units(queries) @ units(v).T, 6)
    return [[(ids[j], row[j]) for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[:k]] for row in scores]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    v[:300] = v[0]  # one list holds many equal vectors
    v[300] = 0
    return v


@pytest.mark.parametrize("parts", [N.PART_ROWS, 50])
def test_lists(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(N, "PART_ROWS", parts)
    monkeypatch.setattr(N, "PART_QUERIES", parts)
    own = [(k, x.tolist(), k % 7) for k, x in enumerate(rows)] + [(2000, None, 1), (2001, [1.0], 1)]
    index = N.inverted(spark.createDataFrame(own, "vec_id long, embedding array<double>, label int").repartition(3))
    assert index.table.count() == 1500 and index.table.where("label = 2").count() == 214
    asked = list(range(0, 1500, 60))
    queries = spark.createDataFrame([(k, 0, rows[k].tolist()) for k in asked] + [(-1, 0, None), (-2, 0, [1.0, 2.0])], "query_id long, sub_ix int, vec array<double>")
    exact = dict(zip(asked, plain(range(1500), rows, rows[asked], 10)))
    assert best(N.nearest(index, queries, 10, probes=10**6), 10) == exact
    some = [k for k in range(1500) if k % 7 == 2 and k % 11 == 0]  # fewer than the pool in any few lists
    filtered = best(N.nearest(index, queries, 15, probes=2, where=(F.col("label") == 2) & (F.col("vec_id") % 11 == 0)), 15)
    assert filtered == dict(zip(asked, plain(some, rows[some], rows[asked], 15)))
    near = best(N.nearest(index, queries, 10, probes=4, complete=False), 10)
    hits = [len({i for i, _ in near[q]} & {i for i, _ in exact[q]}) for q in asked if q >= 300]
    assert sum(hits) >= 0.9 * 10 * len(hits)


def test_recall_of_the_registered_query(spark, data):
    from loamstone.plans.queries import QUERIES

    exact, near = ({(r.query_id, r.id) for r in QUERIES[q](spark, data).collect()} for q in ("lists_topk_all_probed", "lists_topk"))
    assert len(near & exact) >= 0.9 * len(exact)


def test_empty_index(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, 0, [1.0])], "query_id long, sub_ix int, vec array<double>")
    assert N.nearest(N.inverted(none), queries, 5).count() == 0


def test_exact_beyond_the_probed_lists(spark, rows):
    """A query that finds enough in its first list still gets what is nearer elsewhere, zero vectors and queries included."""
    keep = [k for k in range(1500) if k % 3 == 0]
    index = N.inverted(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rows)], "vec_id long, embedding array<double>"))
    asked = list(range(0, 1500, 50))
    queries = spark.createDataFrame([(k, 0, rows[k].tolist()) for k in asked], "query_id long, sub_ix int, vec array<double>")
    wanted = dict(zip(asked, plain(keep, rows[keep], rows[asked], 5)))
    where = F.col("vec_id") % 3 == 0
    assert best(N.nearest(index, queries, 5, probes=1, where=where), 5) != wanted
    assert best(N.nearest(index, queries, 5, probes=1, where=where, exact=True), 5) == wanted


def test_copies_of_queries_are_bounded(monkeypatch, rows):
    """A task that deals queries over all lists holds a bounded number of copies, however many lists there are."""
    import pyarrow as pa

    monkeypatch.setattr(N, "COPIES", 1000)
    centroids = type("Broadcast", (), {"value": N.X._units(pa.array(rows[301:501].tolist()))[1]})
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(rows.tolist())], names=["query_id", "vec"])
    out = list(N._listed(centroids, 1, 200)(iter([batch])))
    assert max(b.num_rows for b in out) <= 1000 and sum(b.num_rows for b in out) == 1500 * 200


def test_rows_meet_the_centroids_in_bounded_steps(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(6)
    centroids, v, seen = rng.normal(size=(40, 4)), rng.normal(size=(500, 4)), []
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    own = N._nearest
    monkeypatch.setattr(N, "_nearest", lambda column, *how: (seen.append(len(column)), own(column, *how))[1])
    monkeypatch.setattr(X, "CELLS", 2_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
    out = [r for b in N._listed(SimpleNamespace(value=centroids), 1, 1)(iter([batch])) for r in b.to_pylist()]
    assert [(r["id"], r["list"]) for r in out] == list(enumerate((v @ centroids.T / np.linalg.norm(v, axis=1, keepdims=True)).argmax(1)))
    assert max(seen) * len(centroids) <= 2_000
