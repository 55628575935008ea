"""Neighbourhood recommendation: exact top-k similarity of a query set against all rows, and predicted scores.

The query set is divided over the tasks; each passes over all vectors in the shared folder, slice by slice (``slices``), and keeps the best of its
queries. No pair is shuffled and none reaches the driver. Vectors without overlap have similarity 0 and count as candidates, as in the full matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut
from . import slices
from .ratings import NEUTRAL

#: Query vectors of a task, neighbours it holds and rows of a batch that leaves it, about, at most.
GROUP_ROWS, GROUP_BEST, ROWS_OUT = 4096, 1_000_000, 500_000
#: Query items of a task that lists all pairs.
GROUP_ITEMS = 256


def long_to_vectors(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``(id, keys, values)``, keys ascending; zeros carry nothing but the id."""
    packed = F.array_sort(F.collect_list(F.when(F.col(value) != 0, F.struct(F.col(at).cast("long").alias("k"), F.col(value).cast("double").alias("v")))))
    return rows.groupBy(F.col(key).cast("long").alias("id")).agg(packed.alias("e")).select("id", F.col("e.k").alias("keys"), F.col("e.v").alias("values"))


def _sized(vectors: DataFrame, cosine: bool) -> DataFrame:
    """``vectors`` with the ``size`` that divides their values."""
    size = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("size", F.when(size > 0, size).otherwise(1.0) if cosine else F.lit(1.0))


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, *, cosine: bool = False) -> DataFrame:
    """``(query, id, s, rank)``: for each of ``queries(id)`` the ``k`` most similar of all ``vectors(id, keys, values)``, itself included.

    Dot products, or cosines (vectors of length 0 stay 0), rounded to 12 places; ties go to the smaller id.
    """
    stored = slices.store(_sized(vectors, cosine))
    asked = stored.table.join(queries.select("id").distinct(), "id", "left_semi")
    files, hot = stored.files, stored.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            asked = slices.rows_of(held)
            best = slices.best_of(asked, files, hot, k)
            rank = best.rank()
            for a in range(0, len(rank), ROWS_OUT):
                own = slice(a, a + ROWS_OUT)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asked.ids[best.q[own]], best.id[own], best.s[own], rank[own].astype(np.int32))], names=["query", "id", "s", "rank"])

    spread = asked.repartition(slices.groups(vectors.sparkSession, asked.count(), max(1, min(GROUP_ROWS, GROUP_BEST // k))), "id")
    return spread.mapInArrow(run, "query long, id long, s double, rank int")


def item_similarity(ratings: DataFrame, queries: DataFrame, value: str) -> DataFrame:
    """``(a, b, s)``: dot products of item columns that share a user, a in ``queries(id)``, b any other item.

    Items meet by a join on the user; those of users who hold one of ``slices.HOT_SHARE`` items or more meet in the tasks, one sum a pair.
    """
    rows = cut(ratings.filter(F.col(value) != 0).select("user_id", F.col("item_id").alias("b"), F.col(value).cast("double").alias("y")), "cells")
    asked_ids = queries.select(F.col("id").alias("b")).distinct()
    items = rows.agg(F.count_distinct("b")).first()[0]
    hot = cut(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * slices.HOT_SHARE > max(items, 1000)).select("user_id"), "hot")
    n = hot.count()
    shared = broadcast_if_small(hot, n, 16)
    cold = rows.join(shared, "user_id", "left_anti") if n else rows
    asked = cold.join(asked_ids, "b", "left_semi").select("user_id", F.col("b").alias("a"), F.col("y").alias("x"))
    sums = asked.join(cold, "user_id").filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    if not n:
        return sums
    stored = slices.store(long_to_vectors(rows.join(shared, "user_id", "left_semi"), "b", "user_id", "y").withColumn("size", F.lit(1.0)))
    files, keys = stored.files, stored.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            mine = slices.rows_of(held)
            for other, q, row, s in slices.sharing_pairs(mine, files, keys):
                for at in range(0, len(s), ROWS_OUT):
                    own = slice(at, at + ROWS_OUT)
                    yield pa.RecordBatch.from_arrays([pa.array(mine.ids[q[own]]), pa.array(other.ids[row[own]]), pa.array(s[own])], names=["a", "b", "s"])

    few = stored.table.join(asked_ids.select(F.col("b").alias("id")), "id", "left_semi")
    spread = few.repartition(slices.groups(ratings.sparkSession, few.count(), GROUP_ITEMS), "id")
    return sums.unionByName(spread.mapInArrow(run, "a long, b long, s double")).groupBy("a", "b").agg(F.sum("s").alias("s"))


def report(top: DataFrame, size: int = 5) -> DataFrame:
    """``(query, neighbours)``: the ranks 2 to ``size`` + 1 as 'id:similarity' separated by spaces; the first is taken for the query itself."""
    rows = top.filter(F.col("rank").between(2, size + 1))
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "s")))
    return rows.groupBy("query").agg(F.concat_ws(" ", F.transform(listed, lambda r: F.concat(r["id"].cast("string"), F.lit(":"), F.format_string("%.6f", r["s"])))).alias("neighbours"))


def predict(top: DataFrame, ratings: DataFrame, pairs: DataFrame, k: int, *, by: str = "user", population: int | None = None) -> DataFrame:
    """``(user_id, item_id, average, weighted)`` of ``pairs(user_id, item_id)`` from the ``k`` + 1 nearest of each query user (or item), itself skipped.

    average: the neighbours' imputed ratings over k; weighted: weighted by similarity over the sum of absolute similarities. Where
    that sum is 0 both are the sum of the item's (user's) imputed ratings over ``population`` - 1, by default the observed users (items).
    3 is added back.
    """
    own, other = ("user_id", "item_id") if by == "user" else ("item_id", "user_id")
    near = top.filter("query <> id").select(F.col("query").alias(own), F.col("id").alias("__n"), "s")
    sums = ratings.groupBy(other).agg(F.sum("x").alias("__sum"))
    if population is None:
        population = ratings.agg(F.count_distinct(own)).first()[0]
    x = ratings.select(F.col(own).alias("__n"), other, "x")
    cells = pairs.select(own, other).join(near, own).join(x, ["__n", other], "left")
    value = F.coalesce("x", F.lit(0.0))
    scored = cells.groupBy(own, other).agg(F.sum(value).alias("a"), F.sum(F.col("s") * value).alias("w"), F.sum(F.abs("s")).alias("m"))
    scored = pairs.select(own, other).join(scored, [own, other], "left").join(sums, other, "left")
    return scored.select("user_id", "item_id", *_predicted(F.lit(k), population))


def _predicted(k: Column, population: int) -> tuple[Column, Column]:
    """average and weighted of a pair's sums ``a``, ``w`` and ``m`` over ``k`` neighbours and ``__sum`` over all."""
    fallback = F.coalesce("__sum", F.lit(0.0)) / F.lit(float(max(population - 1, 1)))
    live = F.coalesce(F.col("m") > 0, F.lit(False))
    return (F.when(live, F.col("a") / k).otherwise(fallback) + NEUTRAL).alias("average"), (F.when(live, F.col("w") / F.col("m")).otherwise(fallback) + NEUTRAL).alias("weighted")


def predict_sweep(vectors: DataFrame, ratings: DataFrame, pairs: DataFrame, ks: Sequence[int], *, cosine: bool = False) -> DataFrame:
    """``(user_id, item_id, score, k, average, weighted)`` of ``pairs(user_id, item_id, score)`` for each of ``ks``, as :func:`predict` of :func:`top_similar` has it by user.

    The neighbours stay in the task that found them: in a second pass over all vectors it adds up their values of the items asked for.
    """
    stored = slices.store(_sized(vectors, cosine))
    listed = F.array_sort(F.collect_list(F.struct("item_id", F.col("score").cast("double").alias("score"))))
    asked = stored.table.join(pairs.groupBy(F.col("user_id").alias("id")).agg(listed.alias("p")), "id").select("id", "keys", "values", "size", F.col("p.item_id").alias("items"), F.col("p.score").alias("scores"))
    files, hot, ks = stored.files, stored.hot, sorted(ks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        asked = slices.rows_of(held)
        best = slices.best_of(asked, files, hot, max(ks) + 1)
        lists = pa.Table.from_batches(held).combine_chunks()
        by_id = np.argsort(lists.column("id").to_numpy(), kind="stable")
        items, scores = (lists.column(c).take(pa.array(by_id)).combine_chunks() for c in ("items", "scores"))
        user, items, scores = np.repeat(np.arange(len(asked.ids)), np.diff(items.offsets.to_numpy())), items.flatten().to_numpy(), scores.flatten().to_numpy()
        reach = np.searchsorted(np.array(ks) + 1, best.rank())  # the first of ks that holds the neighbour
        near = best.id != asked.ids[best.q]
        q, ids, s, reach = best.q[near].astype(np.int64), best.id[near], best.s[near], reach[near]
        below = np.cumsum(np.bincount(q * len(ks) + reach, np.abs(s), len(asked.ids) * len(ks)).reshape(-1, len(ks)), axis=1)
        sums = np.zeros((2, len(items) * len(ks)))
        names = np.unique(items)
        step = max(1, slices.BLOCK_CELLS // max(1, len(names)))
        for rows in slices.read_slices(files, most := max(1, 2 * slices.BLOCK_CELLS), most):
            name = np.searchsorted(names, rows.keys)
            name = np.where(names[np.minimum(name, len(names) - 1)] == rows.keys, name, -1)
            at = np.minimum(np.searchsorted(rows.ids, ids), len(rows.ids) - 1)
            here = np.flatnonzero(rows.ids[at] == ids)
            counts = np.diff(rows.offsets)
            for a in range(0, len(asked.ids), step):
                mine = slice(*np.searchsorted(user, (a, a + step)))
                table = np.full(step * len(names), -1, np.int32)
                table[(user[mine] - a) * len(names) + np.searchsorted(names, items[mine])] = np.arange(mine.start, mine.stop)
                h = here[slice(*np.searchsorted(q[here], (a, a + step)))]
                entry, of = slices.spread(rows.offsets[at[h]], counts[at[h]]), np.repeat(h, counts[at[h]])
                known = name[entry] >= 0
                entry, of = entry[known], of[known]
                cell = table[(q[of] - a) * len(names) + name[entry]]
                wanted = cell >= 0
                cell, of, x = cell[wanted] * len(ks) + reach[of[wanted]], of[wanted], rows.values[entry[wanted]]
                sums[0] += np.bincount(cell, x, len(sums[0]))
                sums[1] += np.bincount(cell, s[of] * x, len(sums[1]))
        a, w = (np.cumsum(x.reshape(-1, len(ks)), axis=1) for x in sums)
        for i, k in enumerate(ks):
            columns = (asked.ids[user], items, scores, np.full(len(items), k, np.int32), a[:, i], w[:, i], below[user, i])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["user_id", "item_id", "score", "k", "a", "w", "m"])

    spread = asked.repartition(slices.groups(vectors.sparkSession, asked.count(), max(1, min(GROUP_ROWS, GROUP_BEST // (max(ks) + 1)))), "id")
    scored = spread.mapInArrow(run, "user_id long, item_id long, score double, k int, a double, w double, m double")
    sums = ratings.groupBy("item_id").agg(F.sum("x").alias("__sum"))
    population = ratings.agg(F.count_distinct("user_id")).first()[0]
    return scored.join(sums, "item_id", "left").select("user_id", "item_id", "score", "k", *_predicted(F.col("k"), population))
