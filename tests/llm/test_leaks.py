"""Leaked items against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from skeinwork.llm import leaks
from skeinwork.llm.leaks import cased, leaked_items, plain_words, window_hashes, words_by_case

DOCS, ITEMS = "doc_id long, text string, item_id long, kind string", "item_id long, text string, doc_id long, size int"


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "k") for d in docs], DOCS), spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS)


def brute(docs, items):
    out = set()
    for d, text in docs:
        have = plain_words((text or "").lower())
        for i, wanted in items:
            w = plain_words((wanted or "").lower())
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
            if any(tuple(have[k : k + n]) in windows for k in range(len(have) - n + 1)) and n:
                out.add((d, i))
    return out


def test_exact(spark):
    random.seed(1)
    words = "alpha beta gamma 12 30 km miles Paris Rome delta".split()
    say = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(k, say(random.randrange(1, 25))) for k in range(40)] + [(100, None), (101, ""), (102, " .. "), (103, say(12)), (104, "Paris"), (105, "Paris")]
    docs = [(k, say(random.randrange(60))) for k in range(80)]
    docs += [(200 + k, say(8) + "... " + items[k][1].upper().replace(" ", "-- ") + "! " + say(5)) for k in range(40)] + [(300, None), (301, ""), (302, "PARIS"), (303, say(20_000)), (302, "paris")]
    t, i = tables(spark, docs, items)
    want = brute(docs, items)
    got = leaked_items(t, i, reparameterised=False)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    full = leaked_items(t, i)
    assert {(r["doc_id"], r["item_id"]) for r in full.filter("kind = 'exact'").collect()} == want
    assert leaked_items(t.limit(0), i).count() == 0 and leaked_items(t, i.limit(0)).count() == 0


def test_reparameterised(spark):
    item = "When the storm hit Velmora, 12 ships carried 400 tons of grain to Dastin before 12 noon"
    same = "When the storm hit Garnok, 15 ships carried 90 tons of grain to Pelfin before 15 noon"
    crossed = "When the storm hit Garnok, 15 ships carried 15 tons of grain to Garnok before 99 noon"
    other = "When the rain hit Garnok, 15 boats carried 90 tons of salt to Pelfin until 15 noon"
    t, i = tables(spark, [(1, item), (2, "He said: " + same), (3, crossed), (4, other)], [(7, item)])
    got = {r["doc_id"]: r["kind"] for r in leaked_items(t, i).collect()}
    assert got[1] == "exact" and got[2] == "reparameterised" and 4 not in got
    short = {r["doc_id"] for r in leaked_items(*tables(spark, [(1, "42 km"), (2, "Paris 7")], [(1, "Rome 9")])).collect()}
    assert short == set()


def test_names_are_those_of_each_text(spark):
    item = "When the storm hit Velmora, 12 ships carried 400 tons of grain to Dastin before 12 noon"
    same = "He said: When the storm hit Rose, 15 ships carried 90 tons of grain to Mark before 15 noon"
    docs = [(1, same), (2, "a rose will mark the spot"), (3, "\u201c" + same + "\u201d \u0130"), (4, "the \u00e9t\u00e9 of rose and mark"), (5, same.replace("Rose", "Garnok")), (6, same.upper())]
    t, i = tables(spark, docs, [(7, item), (8, "it is velmora and dastin, in lower case")])
    for parts in (1, 6):
        got = {(r["doc_id"], r["item_id"], r["kind"]) for r in leaked_items(t.repartition(parts), i).collect()}
        assert {(d, 7, "reparameterised") for d in (1, 3, 5)} <= got and not {g for g in got if g[0] in (2, 4)}


def planted(seed=5, count=60):
    """``(docs, items, truth)``: items of ordinary words with names, numbers and units; each in one text as it is, in one with all slots changed, in one with slots changed inconsistently."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprstv" for b in "aeiou"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    plain = sorted({word(2) for _ in range(300)})
    fresh = lambda: word(4).capitalize()

    def sentence():
        a, b, c = fresh(), fresh(), rng.randrange(10, 5000)
        parts = [rng.choice(plain) for _ in range(16)]
        for slot, at in zip(("{a}", "{c}", "{b}", "{a}", "{c}"), (1, 4, 7, 9, 12)):
            parts[at] = slot
        return " ".join(parts), {"a": a, "b": b, "c": c}

    noise = lambda: " ".join(rng.choice(plain) for _ in range(40))
    docs, items, truth = [], [], set()
    for k in range(count):
        text, values = sentence()
        items.append((k, text.format(**values)))
        docs.append((3 * k, f"{noise()}. {text.format(**values)}. {noise()}"))
        docs.append((3 * k + 1, f"{noise()}. {text.format(a=fresh(), b=fresh(), c=rng.randrange(5000, 9000))}. {noise()}"))
        crossed = text
        for slot in ("{a}", "{b}", "{c}"):
            while slot in crossed:
                crossed = crossed.replace(slot, fresh() if slot != "{c}" else str(rng.randrange(10_000)), 1)
        docs.append((3 * k + 2, f"{noise()}. {crossed}. {noise()}"))
        truth |= {(3 * k, k, "exact"), (3 * k + 1, k, "reparameterised")}
    return docs, items, truth


def test_planted_cases_whatever_the_batches_and_the_join(spark, monkeypatch):
    docs, items, truth = planted()
    t, i = tables(spark, docs, items)
    results = []
    for batch, limit in (("10000", 256), ("1", 256), ("10000", 1 << 40)):
        monkeypatch.setattr(leaks, "WINDOW_BYTES", limit)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        results.append(sorted((r["doc_id"], r["item_id"], r["kind"], r["windows"]) for r in leaked_items(t.repartition(3), i).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert results[0] == results[1] == results[2]
    got = {r[:3] for r in results[0]}
    assert len(got & truth) >= 0.98 * len(truth)  # recall
    # a window of ten words holds each crossed slot once or twice, so some of the inconsistent texts agree within a window; nothing else is found
    assert {d for d, i_, k in got - truth} <= {3 * k + 2 for k in range(60)}


def test_units_and_numbers_are_parameters(spark):
    t, i = tables(spark, [(1, "they carried seven blorps of dry sand over the old hill"), (2, "they carried nine blorps of dry sand over the old hill")], [(1, "they carried nine spengs of dry sand over the old hill")])
    assert not leaked_items(t, i).count()
    assert {(r["doc_id"], r["kind"]) for r in leaked_items(t, i, units=("blorps", "spengs")).collect()} == {(1, "reparameterised"), (2, "reparameterised")}
    assert {r["doc_id"] for r in leaked_items(t, i, units=("blorps", "spengs"), number_words=()).collect()} == {2}
    assert not leaked_items(t, i, units=("blorps", "spengs"), least_equal=0.95).count()


def test_case_of_words():
    for text in ("K \u0130stanbul na\u00efve \u212aelvin", "It\u2019s Velmora\u2019s. A\u0130B \u03a3\u03a3 x9 Rose"):
        assert [w.lower() for w in re.findall("[A-Za-z0-9]+", cased(text))] == plain_words(text.lower())
        assert all(len(x) == len(plain_words(text.lower())) for x in words_by_case(text))


def test_window_hashes():
    codes = np.random.default_rng(0).integers(0, 1 << 62, 50).astype(np.uint64)
    for size in range(1, 12):
        h = window_hashes(codes, size)
        assert len(h) == 51 - size
        again = window_hashes(np.concatenate([codes[5:], codes[:20]]), size)
        assert (h[5:] == again[: len(h) - 5]).all()
    assert len(window_hashes(codes[:3], 4)) == 0


def test_lower_case_of_whole_text(spark):
    docs = [(1, "K İstanbul naïve"), (2, "k i stanbul na ve")]
    items = [(1, "k i stanbul na ve")]
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(*tables(spark, docs, items), reparameterised=False).collect()}
    assert got == brute(docs, items)
    assert F is not None
