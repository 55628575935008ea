"""Similar vectors and clusters against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import clusters, components, links, similar

SCHEMA = "id long, keys array<long>, values array<double>, asks boolean, own int"


def table(spark, vectors):
    return spark.createDataFrame([(k, sorted(v), [float(v[t]) for t in sorted(v)], True, 1) for k, v in vectors.items()], SCHEMA)


def cosine(a, b):
    d = sum(x * b.get(t, 0) for t, x in a.items())
    n = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
    return d / n**0.5 if n else 0.0


def planted(n, seed=0, keys=400, size=20):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        if out and rng.random() < 0.3:
            v = dict(rng.choice(list(out.values())))
            for t in rng.sample(sorted(v), 2):
                v[t] = rng.choice([-2, -1, 1, 2])
        else:
            v = {t: rng.choice([-2, -1, 1, 2]) for t in rng.sample(range(keys), size)}
        out[k] = v
    return out


def pairs_of(vectors, least):
    ids = sorted(vectors)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if cosine(vectors[a], vectors[b]) >= least - 1e-12}


@pytest.mark.parametrize("options", [{}, {"leaf_block": 40}, {"leaf": 8}])
def test_pairs(spark, options):
    vectors = planted(400)
    vectors[1000], vectors[1001] = dict(vectors[0]), dict(vectors[0])  # copies
    pairs, classes = similar.similar_pairs(table(spark, vectors), min_similarity=0.8, **options)
    found = {(r["a"], r["b"]) for r in similar.expand_classes(pairs, classes).collect()}
    want = pairs_of(vectors, 0.8)
    assert found <= want and len(found) >= 0.98 * len(want)
    assert {(0, 1000), (0, 1001), (1000, 1001)} <= found


def test_copies_are_a_third(spark):
    vectors = planted(200, seed=1)
    same = dict(vectors[0])
    vectors |= {5000 + k: dict(same) for k in range(100)}
    pairs, classes = similar.similar_pairs(table(spark, vectors), min_similarity=0.8)
    members = {r["id"]: r["class_id"] for r in classes.collect()}
    assert all(members[5000 + k] == 0 for k in range(100))
    assert all(r["a"] < 5000 and r["b"] < 5000 for r in pairs.collect())


def ranked(vectors, q, k):
    return sorted(((round(-cosine(vectors[q], v), 9), o) for o, v in vectors.items() if o != q))[:k]


@pytest.mark.parametrize("options", [{"exact": True}, {"exact": True, "leaf_block": 40}, {"exact": True, "k": 20}, {"leaf": 16, "visits": 48}, {"leaf": 16, "visits": 48, "leaf_block": 8}])
def test_nearest(spark, options):
    vectors, options = planted(300, seed=2), dict(options)
    k = options.pop("k", 3)
    t = table(spark, vectors)
    near, classes = similar.nearest(t, k, queries=t.filter("id % 20 = 0").select("id"), **options)
    got = {}
    for r in sorted(similar.nearest_members(near, classes, k, F.col("id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append((round(-r["similarity"], 9), r["neighbour"]))
    assert set(got) == {q for q in vectors if q % 20 == 0}
    want = {q: ranked(vectors, q, k) for q in got}
    if options.get("exact"):
        assert got == want
    else:
        assert sum(len(set(got[q]) & set(want[q])) for q in got) >= 0.9 * k * len(got)


def test_nearest_floor(spark):
    vectors = planted(120, seed=4)
    near, classes = similar.nearest(table(spark, vectors), 3, min_similarity=0.5, exact=True)
    want = {(q, o) for q in vectors for s, o in ranked(vectors, q, 3) if -s >= 0.5}
    assert {(r["id"], r["neighbour"]) for r in similar.nearest_members(near, classes, 3).collect()} == want
    assert similar.nearest(table(spark, vectors).limit(0), 3)[0].count() == 0


def test_nearest_users(spark, data):
    from skeinwork.llm import similar_queries as Q

    vectors = {r["id"]: dict(zip(r["keys"], r["values"])) for r in Q.rating_vectors(spark, data, least=1).collect()}
    got = {}
    for r in sorted(Q.p1_nearest(spark, data).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["userid"], []).append((r["other"], r["similarity"]))
    assert set(got) == {u for u in vectors if u % 20 == 0} and all(len(x) == 5 for x in got.values())
    hits = 0
    for q in got:
        assert all(q != o and abs(cosine(vectors[q], vectors[o]) - s) < 1e-8 for o, s in got[q])
        fifth = sorted((cosine(vectors[q], v) for k, v in vectors.items() if k != q), reverse=True)[4]
        hits += sum(s >= fifth - 1e-8 for _, s in got[q])  # of equal similarity any will do
    assert hits >= 0.9 * 5 * len(got)


def test_vector_dirt(spark):
    rows = [(1, [1, 2], [1.0, 1.0]), (2, [1, 2], [2.0, 2.0]), (3, [], []), (4, [1], [0.0]), (None, [1], [1.0]), (5, None, None), (6, [2, 9], [1.0, -1.0])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    pairs, classes = similar.similar_pairs(df, min_similarity=0.9)
    assert [(r["a"], r["b"], round(r["similarity"], 9)) for r in pairs.collect()] == [(1, 2, 1.0)]
    assert {r["id"] for r in classes.collect()} == {1, 2, 6}
    assert similar.similar_pairs(df.limit(0), min_similarity=0.9)[0].count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[find(a)] = find(b)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == set(parent)
    assert len({(find(k), c) for k, c in got.items()}) == len({find(k) for k in got}) == len(set(got.values()))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def entries(spark, records):
    rows = [(d, k, t, f, "x", 1.0) for d, v in records.items() for k, (t, f) in enumerate(v.items())]
    return spark.createDataFrame(rows, "doc_id long, pos int, term int, freq int, id string, s double")


def test_clusters(spark):
    rng = random.Random(6)
    records = {}
    for k in range(300):
        if k % 3 and records:
            v = dict(records[rng.choice(sorted(records))])
            for t in rng.sample(sorted(v), min(4, len(v))):
                v[t] = rng.randrange(1, 6)
        else:
            v = {t: rng.randrange(1, 6) for t in rng.sample(range(600), 15)}
        records[k] = v
    records[900] = dict(records[0])
    members, near, classes = clusters.record_clusters(entries(spark, records))
    got = {r["doc_id"]: r["cluster_id"] for r in members.collect()}
    df = {}
    for v in records.values():
        for t in v:
            df[t] = df.get(t, 0) + 1
    kept = {d: {t: f for t, f in v.items() if 5 * df[t] <= len(records)} for d, v in records.items()}
    label = {d: d for d in records}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in sorted(pairs_of(kept, 0.5)):
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    want = {d: find(d) for d in records if kept[d]}
    assert set(got) == set(want)
    assert sum(got[d] == want[d] for d in want) >= 0.98 * len(want)
    assert all(len({want[d] for d in want if got[d] == c}) == 1 for c in set(got.values()))  # nothing is joined wrongly
    rows = clusters.describe(members, near, classes).collect()
    sizes = {}
    for r in members.collect():
        sizes[r["community_id"]] = sizes.get(r["community_id"], 0) + 1
    assert all(r["size"] == sizes[r["community_id"]] >= 2 and 1 <= len(r["typical"]) <= 3 for r in rows)


def test_clusters_miss_no_link(spark):
    rng = random.Random(8)
    records = {k: {10_000 * (k + 1) + t: 1 for t in range(20)} for k in range(120)}  # like no other
    for k in range(90):  # of three that share six terms each has six of its own, which are rarer
        records[200 + k] = {t: 1 for t in range(6 * (k // 3), 6 * (k // 3) + 6)} | {1000 * (k + 1) + t: 1 for t in range(6)}
    for k in range(240):  # many pairs near 0.5
        records[1000 + k] = {5_000_000 + t: rng.choice([1, 2]) for t in rng.sample(range(40), 8)}
    members, near, classes = clusters.record_clusters(entries(spark, records))
    got = {r["doc_id"]: r["cluster_id"] for r in members.collect()}
    df = {}
    for v in records.values():
        for t in v:
            df[t] = df.get(t, 0) + 1
    kept = {d: {t: f for t, f in v.items() if 5 * df[t] <= len(records)} for d, v in records.items()}
    want = {d: d for d in records}
    for a, b in sorted(pairs_of(kept, 0.5)):
        x, y = want[a], want[b]
        want = {d: min(x, y) if c in (x, y) else c for d, c in want.items()}
    assert got == want and all(got[200 + k] == 200 + k // 3 * 3 for k in range(90))
    found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in near.filter("s >= 0.5").collect()}
    assert found <= pairs_of(kept, 0.5)
    assert {r["cluster_id"] for r in clusters.describe(members, near, classes).collect()} >= {200 + 3 * k for k in range(30)}


@pytest.mark.parametrize("block", [8192, 5])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_links_between_groups(spark, block, threshold):
    vectors = {k: {t: abs(f) for t, f in v.items()} for k, v in planted(250, seed=7, keys=90, size=12).items()}
    want = pairs_of(vectors, threshold)
    known = {k: min(k, next((b for a, b in sorted(want) if a == k), k)) if k % 2 else k // 50 for k in vectors}  # groups of any kind
    groups = spark.createDataFrame([(k, c) for k, c in known.items() if c != k], "id long, component long")
    found = links.links_between(table(spark, vectors), groups, threshold, block=block).collect()
    assert all((min(r["a"], r["b"]), max(r["a"], r["b"])) in want and abs(cosine(vectors[r["a"]], vectors[r["b"]]) - r["s"]) < 1e-9 for r in found)
    assert all((r["x"], r["y"]) == (known[r["a"]], known[r["b"]]) for r in found)

    def whole(ends):
        label = {c: c for c in known.values()}
        for a, b in ends:
            x, y = label[a], label[b]
            label = {d: min(x, y) if c in (x, y) else c for d, c in label.items()}
        return label

    assert whole((r["x"], r["y"]) for r in found) == whole((known[a], known[b]) for a, b in want)


def modularity(links, label):
    total = 2 * sum(s for _, _, s in links)
    mass = {}
    for a, b, s in links:
        for x in (a, b):
            mass[label[x]] = mass.get(label[x], 0) + s
    return sum(2 * s for a, b, s in links if label[a] == label[b]) / total - sum(m * m for m in mass.values()) / total**2


@pytest.mark.parametrize("task_links", [200_000, 0])
def test_communities(spark, task_links):
    cliques = [(base + i, base + j, 0.9) for base, n in ((0, 8), (10, 8), (20, 12)) for i in range(n) for j in range(i + 1, n)] + [(0, 10, 0.5), (11, 21, 0.55)]
    label = {r["id"]: r["community"] for r in clusters.communities(spark.createDataFrame(cliques, "a long, b long, s double"), 0.5, task_links=task_links).collect()}
    assert {frozenset(k for k in label if label[k] == c) for c in label.values()} == {frozenset(range(8)), frozenset(range(10, 18)), frozenset(range(20, 32))}
    ring = [(k, (k + 1) % 40, 0.6) for k in range(40)] + [(3, 9, 0.2)]
    label = {r["id"]: r["community"] for r in clusters.communities(spark.createDataFrame(ring, "a long, b long, s double"), 0.5, task_links=task_links).collect()}
    assert modularity(ring[:-1], label) > 0.6  # the best has 0.68, pairs have 0.45
    assert clusters.communities(spark.createDataFrame([], "a long, b long, s double"), 0.5).count() == 0


@pytest.mark.parametrize("task_links", [200_000, 0])
def test_communities_end_when_nothing_moves(spark, task_links):
    rng = random.Random(11)
    links = {}
    for _ in range(1200):  # groups of groups, loosely linked
        a = rng.randrange(400)
        b = a // 8 * 8 + rng.randrange(8) if rng.random() < 0.7 else a // 40 * 40 + rng.randrange(40) if rng.random() < 0.7 else rng.randrange(400)
        if a != b:
            links[min(a, b), max(a, b)] = round(rng.uniform(0.5, 1), 3)
    rows = [(a, b, s) for (a, b), s in links.items()] + [(1000 + k, 1001 + k, 0.7) for k in range(200)]
    label = {r["id"]: r["community"] for r in clusters.communities(spark.createDataFrame(rows, "a long, b long, s double"), 0.5, task_links=task_links).collect()}
    whole, names = modularity(rows, label), sorted(set(label.values()))
    parts = spark.createDataFrame(list(label.items()), "id long, community long")
    assert abs(clusters.modularity(spark.createDataFrame(rows, "a long, b long, s double"), 0.5, parts) - whole) < 1e-9
    assert all(min(k for k in label if label[k] == c) == c for c in names)
    between = {tuple(sorted((label[a], label[b]))) for a, b, _ in rows if label[a] != label[b]}
    assert names and between
    for x, y in between:  # no two linked communities gain by joining
        assert modularity(rows, {k: x if c == y else c for k, c in label.items()}) <= whole + 1e-8


def test_copies_count_for_typical_members(spark):
    members = spark.createDataFrame([(k, 1, 1) for k in range(1, 9)] + [(20, 20, 20), (21, 20, 20)], "doc_id long, cluster_id long, community_id long")
    classes = spark.createDataFrame([(k, 1) for k in range(1, 6)] + [(6, 6), (7, 7), (8, 8), (20, 20), (21, 20)], "id long, class_id long")  # 1 to 5 are copies
    near = spark.createDataFrame([(1, 6, 0.6), (6, 1, 0.6), (6, 7, 0.9), (7, 6, 0.9), (7, 8, 0.9)], "a long, b long, s double")
    got = {r["community_id"]: (r["size"], r["typical"]) for r in clusters.describe(members, near, classes, typical=6).collect()}
    # copies 4 + 0.6, 6: 5 * 0.6 + 0.9, 7: 1.8, 8: 0.9
    assert got == {1: (8, [1, 2, 3, 4, 5, 6]), 20: (2, [20, 21])}


def test_cluster_dirt(spark):
    rows = [(1, 0, 5, 2, "x", 1.0), (1, 0, 5, 2, "x", 1.0), (2, 0, None, 1, "x", 1.0), (3, 0, 6, 0, "x", 1.0), (None, 0, 6, 1, "x", 1.0), (4, None, 7, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, term int, freq int, id string, s double")
    assert clusters.record_clusters(df)[0].count() == 0  # its one term is in every record
    more = rows + [(10 + k, 0, 100 + k, 1, "x", 1.0) for k in range(9)]
    assert {r["doc_id"] for r in clusters.record_clusters(spark.createDataFrame(more, df.schema))[0].collect()} == {1, *range(10, 19)}
    assert clusters.record_clusters(df.limit(0))[0].count() == 0


def test_projection_is_stable():
    from skeinwork.llm.forest import Forest, hashed_signs, project

    keys = np.arange(50, dtype=np.int64)
    assert (hashed_signs(keys, 100, 1)[10:20] == hashed_signs(keys[10:20], 100, 1)).all()
    p = project(keys, np.ones(50), np.array([0, 20, 20, 50]), 64, 1, block=8)
    assert p.shape == (3, 64) and (p[1] == 0).all()
    sample = np.random.default_rng(0).normal(size=(500, 12)).astype(np.float32)
    forest = Forest(sample, 3, 4)
    assert all((np.sort(forest.search(sample, 48), axis=1) == np.arange(48)).all(axis=1))  # all leaves, once each
    assert all(set(a) <= set(b) for a, b in zip(forest.leaves(sample), forest.search(sample, 12)))
