"""Products of sparse vectors by slices, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import cluster, knn, letor, pmf, slices


def top_plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().split()[0]


def entries_of(seed: int, rows: int, keys: int, values) -> dict:
    r = np.random.default_rng(seed)
    return {i: {0: float(r.choice(values)), **{int(k): float(r.choice(values)) for k in r.integers(0, keys, r.integers(0, 6))}} if i % 9 else {} for i in range(rows)}


@pytest.mark.parametrize("values", [(1.0, 2.0, 3.0), (-2.0, -1.0, 0.0, 1.0)])
def test_pair_similarities_by_slices(spark, monkeypatch, values):
    v = entries_of(1, 90, 200, values)
    table = spark.createDataFrame([(i, k, x) for i, e in v.items() for k, x in e.items()], "doc_id long, term int, weight double")
    pairs = cluster.pair_similarities(table, table.filter("doc_id % 4 = 0").select("doc_id"))
    assert top_plan(pairs) == "MapInArrow"  # no pair is joined, shuffled or summed up after the tasks
    found = {(r["a"], r["b"]): (r["cosine"], r["inverse_distance"]) for r in pairs.collect()}
    want = {}
    for a in (i for i in v if i % 4 == 0 and v[i]):
        for b in (j for j in v if j != a and v[a].keys() & v[j].keys()):
            na, nb, d = sum(x * x for x in v[a].values()), sum(x * x for x in v[b].values()), sum(x * v[b][k] for k, x in v[a].items() if k in v[b])
            want[a, b] = (d / (na**0.5 * nb**0.5) if na * nb else None, (na + nb - 2 * d) ** -0.5 if na + nb - 2 * d > 0 else float("inf"))
    assert found.keys() == want.keys()
    for p, (c, i) in want.items():
        assert (found[p][0] is None) == (c is None) and (c is None or abs(found[p][0] - c) < 1e-12) and (found[p][1] == i or abs(found[p][1] - i) < 1e-12)


@pytest.mark.parametrize("values", [(1.0, 2.0), (-2.0, -1.0, 0.0, 1.0)])
@pytest.mark.parametrize("cosine", [True, False])
def test_top_similar_by_slices(spark, monkeypatch, values, cosine):
    """Small first slices of ascending ids in a file, against all pairs: later slices add what is better, ties go to the smaller id."""
    v = entries_of(2, 400, 120, values)
    table = spark.createDataFrame([(i, [k for k, x in sorted(e.items()) if x], [x for _, x in sorted(e.items()) if x]) for i, e in v.items()], "id long, keys array<long>, values array<double>")
    stored = slices.store(knn._sized(table, cosine))
    asked = slices.rows_of(stored.table.filter("id % 7 = 0").toArrow().to_batches())
    monkeypatch.setattr(slices, "FIRST_ROWS", 20)
    best = slices.best_of(asked, stored.files, stored.hot, 5)
    dense = np.zeros((400, 120))
    for i, e in v.items():
        dense[i, list(e)] = list(e.values())
    size = np.sqrt((dense**2).sum(axis=1, keepdims=True)) if cosine else 1.0
    unit = dense / np.where(size > 0, size, 1.0)
    s = np.round(unit @ unit.T, 12)
    got: dict = {}
    for q, i in zip(asked.ids[best.q], best.id):
        got.setdefault(int(q), []).append(int(i))
    assert got == {int(q): sorted(range(400), key=lambda i: (-s[q, i], i))[:5] for q in asked.ids}


def test_top_similar_leaves_the_tasks_ranked(spark):
    table = spark.createDataFrame([(i, [i % 3], [1.0]) for i in range(30)], "id long, keys array<long>, values array<double>")
    top = knn.top_similar(table, table.select("id"), 4, cosine=True)
    assert top_plan(top) == "MapInArrow"  # no block of queries is held by the driver, no neighbour shuffled
    assert sorted((r["query"], r["rank"], r["id"]) for r in top.filter("query = 4").collect()) == [(4, 1, 1), (4, 2, 4), (4, 3, 7), (4, 4, 10)]


def test_sweep_equals_predictions(spark):
    r = spark.createDataFrame([(u, i, float((u * i) % 5 + 1), float((u * i) % 5 - 2)) for u in range(40) for i in range(u % 4, 12, 3)], "user_id long, item_id long, score double, x double")
    v, pairs = knn.long_to_vectors(r, "user_id", "item_id", "x"), r.filter("user_id % 5 = 0").select("user_id", "item_id", "score")
    swept = knn.predict_sweep(v, r, pairs, (2, 7), cosine=True)
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 2  # asked users and item sums only: neighbours are joined with no rating
    got = {(x["k"], x["user_id"], x["item_id"]): (x["average"], x["weighted"]) for x in swept.collect()}
    top = knn.top_similar(v, pairs.select(F.col("user_id").alias("id")), 8, cosine=True)
    want = {(k, x["user_id"], x["item_id"]): (x["average"], x["weighted"]) for k in (2, 7) for x in knn.predict(top.filter(F.col("rank") <= k + 1), r, pairs, k).collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[p] for p in want], list(want.values()), rtol=0, atol=1e-12)


def test_items_of_hot_users_meet_in_the_tasks(spark, monkeypatch):
    cells = {(u, i): float((u * 7 + i * 3) % 4 - 1) for u in range(30) for i in range(1200) if u < 2 or (u * i) % 97 == 3}  # users 0 and 1 hold all items
    r = spark.createDataFrame([(u, i, x) for (u, i), x in cells.items()], "user_id long, item_id long, x double")
    sums = knn.item_similarity(r, r.filter("item_id % 200 = 0").select(F.col("item_id").alias("id")).distinct(), "x")
    assert "MapInArrow" in sums._jdf.queryExecution().optimizedPlan().toString()
    want: dict = {}
    for (u, a), x in cells.items():
        for b in range(1200):
            if a % 200 == 0 and a != b and x and cells.get((u, b)):
                want[a, b] = want.get((a, b), 0.0) + x * cells[u, b]
    assert {(x["a"], x["b"]): x["s"] for x in sums.collect()} == want


def test_sample_pairs_are_not_shuffled(spark):
    r = spark.createDataFrame([(u, i, float(5 if i % 2 else 1)) for u in range(3) for i in range(6)], "user_id long, item_id long, score double")
    u, v = pmf.hashed_factors(r, "user_id", "u"), pmf.hashed_factors(r, "item_id", "v")
    samples = letor.pair_samples(r, u, v)
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert samples.count() == 54
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "low#" in joins[0]  # the last join makes the pairs
