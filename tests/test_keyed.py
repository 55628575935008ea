import random
from collections import Counter

from pyspark.sql import functions as F

from skeinwork.operators.keyed import CHUNK, chunked_fold, heavy_keys, key_profile, number_chunks

SCHEMA = "pos long, movieid long, userid long, score double, n string"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_hot_key_is_cut_into_equal_chunks(spark):
    rows = [(k, 1 if k % 3 else k, k % 50, 1.0, "x") for k in range(3000)]
    chunks, totals = number_chunks(log(spark, rows).repartition(6), "movieid", order="pos", chunk_rows=100)
    sizes = {(r["movieid"], r[CHUNK]): r["count"] for r in chunks.groupBy("movieid", CHUNK).count().collect()}
    assert sum(sizes.values()) == 3000 and max(sizes.values()) <= 100
    hot = sorted((c, n) for (m, c), n in sizes.items() if m == 1)
    assert [n for _, n in hot[:-1]] == [100] * (len(hot) - 1)
    places = chunks.filter("movieid = 1").groupBy(CHUNK).agg(F.min("pos").alias("a"), F.max("pos").alias("z")).orderBy(CHUNK).collect()
    assert all(x["z"] < y["a"] for x, y in zip(places, places[1:]))
    assert totals.filter("movieid = 1").first()["__total"] == 2000


def test_fold_matches_plain_counts(spark):
    random.seed(3)
    rows = [(k, random.choice([1, 1, 1, 2, None]), 7, float(k % 5), "a") for k in range(500)]
    out = chunked_fold(log(spark, rows), "movieid", {"n": F.count(F.lit(1)), "s": F.sum("score")}, {"n": F.sum("n"), "s": F.sum("s")}, chunk_rows=40)
    assert {r["movieid"]: r["n"] for r in out.collect()} == dict(Counter(r[1] for r in rows))


def test_heavy_keys_dirt(spark):
    rows = [(k, 5, k + 1, None if k % 2 else float("nan"), "x") for k in range(150)] + [(900 + k, None, None, 1.0, "y") for k in range(45)] + [(999, -3, 0, 2.0, None)] * 9
    rows += rows[:100]
    found = {(r["key_kind"], r["key_id"]): r["n"] for r in heavy_keys(log(spark, rows), ["movieid", "userid"], chunk_rows=20).collect()}
    assert found == {("movieid", 5): 150}
    assert heavy_keys(log(spark, []), ["movieid", "userid"]).count() == 0
    exact = [(k, 1 if k < 7 else 1000 + k, 0, 1.0, "x") for k in range(700)]  # 7 is one in 100 of 700
    assert [r["key_id"] for r in heavy_keys(log(spark, exact), ["movieid"]).collect()] == [1]


def test_profile_merges_boundaries(spark):
    random.seed(5)
    rows = [(k, random.choice([1, 1, 1, 2]), 1, random.choice([1.0, 2.0, None, float("nan")]), "x") for k in range(400)]
    rows += rows[:50]
    out = {r["key_id"]: r for r in key_profile(log(spark, rows), "movieid", order="pos", value="score", chunk_rows=17).collect()}
    for key in (1, 2):
        seen = [str(r[3]) for r in sorted(set(map(str, [])) or rows[:400], key=lambda r: r[0]) if r[1] == key]
        assert out[key]["n"] == len(seen)
        assert out[key]["changes"] == sum(a != b for a, b in zip(seen, seen[1:]))
        assert str(out[key]["first_value"]) == seen[0] and str(out[key]["last_value"]) == seen[-1]
    assert key_profile(log(spark, []), "movieid", order="pos", value="score").count() == 0
