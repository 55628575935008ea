"""Term counts, term weights, top items, fused rankings."""

import math
import random
from collections import Counter

import pytest

from skeinwork.llm import fuse, radix, terms, topn
from skeinwork.llm.words import word_lists

VECTORS = "doc_id long, pos int, term int, freq int, total long, h string"
TEXTS = "doc_id long, text string, term string, records int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)


def texts(spark, rows):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], TEXTS)


DIRTY = [(1, 0, 5, 2), (1, 0, 5, 2), (1, 1, 5, 3), (1, 2, 7, 1), (2, 0, 5, 1), (2, 1, None, 4), (2, 2, 9, 0), (3, 0, 8, None), (None, 0, 5, 1), (4, 0, 5, -2), (5, None, 7, 1), (6, 0, None, None)]


def test_words():
    import pyarrow as pa

    given = ["Don't eat-here, café 4U a,b 100% The_food", None, "", " \n\t", "A\x0bB\x0cC", "x1 y2", "naïve İstanbul K"]
    assert [[w.decode() for w in ws] for ws in word_lists(pa.array(given))] == [["dont", "eathere", "caf", "ab", "thefood"], [], [], [], ["a", "b", "c"], [], ["na", "ve", "stanbul", "k"]]


def test_counts_of_dirt(spark):
    t = texts(spark, [(1, "the cat the dog"), (2, None), (3, ""), (4, "The 4x"), (5, "the " * 5000), (5, "the " * 5000), (None, "cat"), (6, "12 34")])
    out = {(r["fieldname"], r["term"]): (r["total"], r["records"], r["n_records"], r["mark"]) for r in terms.term_counts(vectors(spark, DIRTY), t).collect()}
    assert out["docvectors", "5"] == (6, 2, 3, "rare") and out["docvectors", "7"] == (2, 2, 3, "rare")
    assert ("docvectors", "9") not in out and ("docvectors", "8") not in out
    assert out["text", "the"] == (10003, 4, 5, "common") and out["text", "cat"] == (2, 2, 5, "rare")
    assert terms.term_counts(vectors(spark, []), texts(spark, [])).count() == 0


def test_radix_splits(spark):
    random.seed(1)
    rows = [("f", random.choice(["hot", "w%d" % random.randrange(300), None]), 1, 1) for _ in range(4000)]
    partials = spark.createDataFrame(rows, radix.PARTIAL)
    out = {r["term"]: (r["total"], r["records"]) for r in radix.radix_counts(partials, cell_bytes=3000).collect()}
    assert out == {t: (n, n) for t, n in Counter(r[1] for r in rows).items()}
    table = partials.withColumn("h", __import__("pyspark.sql.functions", fromlist=["x"]).xxhash64("fieldname", "term"))
    bits, splits = radix.plan_cells(table, 3000)
    assert bits > 0 and splits and len(splits) < 17  # the hot term ends the recursion once alone


def brute_weights(docs, top=3):
    """docs: {id: Counter}"""
    n = sum(1 for c in docs.values() if c)
    df = Counter(t for c in docs.values() for t in c)
    out = set()
    for d, c in docs.items():
        best = sorted(((-round(f * math.log(1 + n / df[t]), 6), t) for t, f in c.items()))[:top]
        out |= {(d, t) for _, t in best}
    return out


def test_weights(spark):
    random.seed(2)
    rows = [(d, " ".join(random.choices("a b c d e f g h the the the".split(), k=random.randrange(12)))) for d in range(60)]
    t = texts(spark, rows)
    want = brute_weights({d: Counter(s.split()) for d, s in rows})
    for options in ({}, {"dictionary_bytes": 0}):
        assert {(r["doc_id"], r["term"]) for r in terms.text_weights(t, **options).collect()} == want
    entries = [(d, k, ord(w) if len(w) == 1 else 1, 1) for d, s in rows for k, w in enumerate(s.split())]
    want = brute_weights({d: Counter(ord(w) if len(w) == 1 else 1 for w in s.split()) for d, s in rows})
    assert {(r["doc_id"], r["term"]) for r in terms.vector_weights(vectors(spark, entries)).collect()} == want


def degrees(words, window):
    out = {w: set() for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1 : i + window]:
            if a != b:
                out[a].add(b)
                out[b].add(a)
    return {w: len(s) for w, s in out.items()}


def test_degrees(spark):
    random.seed(3)
    for block in (7, 100_000):
        words = [random.randrange(6) for _ in range(60)]
        v = vectors(spark, [(1, k, w, 1) for k, w in enumerate(words)] + [(2, 0, 9, 1)])
        got = {(r["doc_id"], r["term"]): r["f"] for r in terms.vector_degrees(v, 4, block=block).collect()}
        assert got == {**{(1, w): n for w, n in degrees(words, 4).items()}, (2, 9): 0}
    names = [str(w).encode() for w in words]
    assert terms._measure(names, "degree", 4) == {str(w).encode(): n for w, n in degrees(words, 4).items()}


def test_weights_of_dirt(spark):
    t = texts(spark, [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two two")])
    got = sorted(map(str, ((r["doc_id"], r["term"]) for r in terms.text_weights(t).collect())))
    assert got == ["(3, 'one')", "(3, 'one')", "(None, 'two')"]
    assert sorted(map(str, ((r["doc_id"], r["term"]) for r in terms.text_weights(t, dictionary_bytes=0).collect()))) == got
    assert terms.term_weights(vectors(spark, []), texts(spark, [])).count() == 0
    assert terms.term_weights(vectors(spark, DIRTY), texts(spark, []), measure="degree").count() > 0


LOG = "pos long, g long, i long, s double, t timestamp_ntz, n string"


def brute_top(rows, n, dedupe):
    from datetime import datetime

    if dedupe:
        best = {}
        for r in rows:
            key = (r[1], r[2])
            rank = (-1 if r[0] is None else r[0], r[3], r[4] or datetime.min)
            if key not in best or rank > best[key][0]:
                best[key] = (rank, r)
        rows = [r for _, r in best.values()]
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((-r[3], -(r[4] - datetime(1970, 1, 1)).total_seconds() if r[4] else math.inf, r[2]))
    return sorted((g, x[2]) for g, xs in groups.items() for x in sorted(xs)[:n])


@pytest.mark.parametrize("file_rows,row_group_rows", [(1_000_000, 20_000), (300, 100), (50, 100)])
def test_top(spark, file_rows, row_group_rows):
    from datetime import datetime, timedelta

    random.seed(4)
    rows = [(k, random.choice([1, 1, 1, 2, 3, 4]), random.randrange(900), float(random.randrange(1, 6)), random.choice([None, datetime(2020, 1, 1) + timedelta(days=random.randrange(5))]), "x") for k in range(3000)]
    rows += rows[:200]
    dirt = [(9000, None, 1, 5.0, None, "x"), (9001, 1, None, 5.0, None, "x"), (9002, 1, 2000, None, None, "x"), (9003, 1, 2001, float("nan"), None, "x")]
    df = spark.createDataFrame(rows + dirt, LOG)
    for dedupe in (True, False):
        got = topn.top_n(df, "g", "i", "s", 5, recent="t", latest_by="pos" if dedupe else None, file_rows=file_rows, row_group_rows=row_group_rows)
        assert sorted((r["g"], r["i"]) for r in got.collect()) == brute_top(rows, 5, dedupe)
    assert topn.top_n(df.limit(0), "g", "i", "s", 5).count() == 0


def test_row_groups_are_skipped(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("1L as g", "double(5 - id div 5000) as s", "-9223372036854775808L as t", "id as i")
    rows.coalesce(1).write.option("parquet.block.row.count.limit", 1000).option("parquet.block.size", 20_000).parquet(str(tmp_path / "t"))
    stats = {}
    path = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    found = topn._read_file(str(path), 5, stats)
    assert found.column(3).to_pylist() == [0, 1, 2, 3, 4]
    assert stats["skipped"] > stats["read"]


SCORES = "query_name string, docid long, run string, score double, rank int, fused double"


def scores(spark, rows):
    return spark.createDataFrame([(*r, 1, 1.0) for r in rows], SCORES)


def test_fusion_of_dirt(spark):
    inf = float("inf")
    rows = [("q", 1, "a", 5.0), ("q", 1, "a", 7.0), ("q", 2, "a", 6.0), ("q", 3, "a", None), ("q", 3, "b", 1.0), ("q", 4, "b", inf), ("q", 5, "b", float("nan")), (None, 1, "a", 1.0), ("q", None, "a", 1.0), ("q", 1, None, 1.0), ("q", 2, "b", 1.0), ("q", 2, "b", 1.0), ("r", 9, "c", -1e300)]
    out = {(r["query_name"], r["docid"]): (r["fused"], r["rank"]) for r in fuse.fused_ranking(scores(spark, rows), combine="sum").collect()}
    # places a: 1, 2, missing 3; b: 2, 3 tie on score by docid, missing 3; c: missing everywhere, 1
    assert out == {("q", 1): (1 + 3 + 1, 2), ("q", 2): (2 + 1 + 1, 1), ("q", 3): (3 + 2 + 1, 3), ("r", 9): (1 + 1 + 1, 1)}
    assert fuse.fused_ranking(scores(spark, [])).count() == 0
    assert fuse.fused_ranking(scores(spark, []), combine="sum", top=3).count() == 0
    with pytest.raises(ValueError):
        fuse.fused_ranking(scores(spark, rows), combine="x")


def test_contradicting_run_has_a_say(spark):
    placed = spark.createDataFrame([(k, k, 9 - k) for k in range(1, 9)], "p_0 long, p_1 long, p_2 long")
    _, _, loadings = fuse.first_component(placed, ["p_0", "p_1", "p_2"])
    assert all(abs(x - 3**-0.5) < 1e-9 for x in loadings)


def test_component_ignores_scale(spark):
    random.seed(5)
    base = [("q%d" % (d % 7), d, random.random()) for d in range(140)]
    rows = [(q, d, run, (x + random.gauss(0, 0.1)) * scale) for q, d, x in base for run, scale in (("a", 1), ("b", 1e6))] + [(q, d, "c", -x) for q, d, x in base]
    one = fuse.fused_ranking(scores(spark, rows), directions={"c": -1})
    two = fuse.fused_ranking(scores(spark, [(q, d, r, math.exp(s * 1e-6) if r == "b" else s) for q, d, r, s in rows]), directions={"c": -1})
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    top = {r["docid"] for r in one.filter("rank <= 5").collect()}
    best = {d for q in {b[0] for b in base} for _, d in sorted(((-x, d) for p, d, x in base if p == q))[:5]}
    assert len(top & best) >= 0.7 * len(best)


def test_a_hot_term_has_one_partial_a_task(spark):
    entries = spark.range(4000).selectExpr("7 AS term", "1 AS f").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    rows = terms.vector_partials(entries, "x").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) <= 3 and sum(r["total"] for r in rows) == sum(r["records"] for r in rows) == 4000


def test_candidates_by_component_lose_no_smallest_sum(spark):
    import random

    rng = random.Random(9)
    rows = [(f"q{q}", d, run, rng.choice([1.0, 2.0, rng.random() * (-1 if run == "c" else 1)])) for q in range(6) for d in range(5 if q == 5 else 60) for run in "abc" if rng.random() < 0.8]
    scores = spark.createDataFrame(rows, "query_name string, docid long, run string, score double")
    whole = fuse.fused_ranking(scores, combine="sum").filter("rank <= 10")
    some = fuse.fused_ranking(scores, combine="sum", top=10)
    key = lambda df: sorted((r["query_name"], r["docid"], r["fused"], r["rank"]) for r in df.collect())
    assert key(some) == key(whole)


def test_six_places():
    assert [terms._six_places(x) for x in (1.0000005, 2.5e-7, 0.1234564999, 3.0)] == [1.000001, 0.0, 0.123456, 3.0]
