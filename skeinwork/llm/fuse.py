"""One ranking from several scores of different scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.topk import group_positions
from ..session import cut


def places(scores: DataFrame, query: str, item: str, run: str, score: str, runs: Sequence[str], directions: Mapping[str, int] | None = None) -> DataFrame:
    """``(query, item, p_0 ... p_k)``: the place of each item in each of ``runs`` of its query, best first.

    Only finite scores count; an item twice in a run keeps its better score; ties go to the smaller item. An item without
    a score in a run gets the number of items in that run of the query plus one, so 1 where the query lacks the run.
    Null queries, items and runs are left out. ``directions`` has -1 for runs where smaller is better.
    """
    directions = dict(directions or {})
    sign = F.lit(1.0)
    for name, d in directions.items():
        sign = F.when(F.col(run) == name, F.lit(float(d))).otherwise(sign)
    value = F.col(score).cast("double")
    kept = scores.filter(F.col(query).isNotNull() & F.col(item).isNotNull() & F.col(run).isin(list(runs)) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    best = kept.groupBy(F.col(query).alias("q"), F.col(item).cast("long").alias("i"), F.col(run).alias("r")).agg(F.max(value * sign).alias("s"))
    placed = group_positions(best, ["q", "r"], [F.desc("s"), F.col("i").asc()], "p")
    wide = placed.groupBy("q", "i").agg(*(F.max(F.when(F.col("r") == name, F.col("p"))).alias(f"p_{k}") for k, name in enumerate(runs)))
    # the largest place of a run is its number of items
    missing = wide.groupBy("q").agg(*((F.coalesce(F.max(f"p_{k}"), F.lit(0)) + 1).alias(f"m_{k}") for k in range(len(runs))))
    return wide.join(missing, "q").select(F.col("q").alias(query), F.col("i").alias(item), *(F.coalesce(f"p_{k}", f"m_{k}").cast("long").alias(f"p_{k}") for k in range(len(runs))))


def first_component(table: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(means, deviations, loadings)`` of the columns: first principal component of their correlation matrix.

    One aggregation gives all sums and products; the matrix has len(columns) squared cells. Every column is oriented
    alike by the declared directions, so every loading has its size and that direction's sign, here positive: a run
    that contradicts the rest has its say too. Constant columns get loading 0. No rows, or all columns constant, give equal loadings.
    """
    k = len(columns)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    first = table.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{a}") for a, c in enumerate(columns))).first()
    n, means = first["n"], np.array([first[f"m{a}"] or 0.0 for a in range(k)])
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, means)]
    row = table.agg(*(F.sum(centred[a] * centred[b]).alias(f"x{a}_{b}") for a, b in pairs)).first()
    cov = np.zeros((k, k))
    for a, b in pairs:
        cov[a, b] = cov[b, a] = (row[f"x{a}_{b}"] or 0.0) / max(n, 1)
    dev = np.sqrt(np.diag(cov))
    live = dev > 1e-12
    if not live.any():
        return means, np.ones(k), np.full(k, k**-0.5)
    safe = np.where(live, dev, 1.0)
    corr = cov / np.outer(safe, safe)
    corr[~live] = corr[:, ~live] = 0.0
    vector = np.linalg.eigh(corr)[1][:, -1]
    vector = np.where(live, np.abs(vector), 0.0)
    return means, safe, vector / np.linalg.norm(vector)


def _projection(columns: Sequence[str], means: np.ndarray, dev: np.ndarray, loadings: np.ndarray) -> Column:
    terms = [F.lit(float(w / d)) * (F.col(c) - F.lit(float(m))) for c, m, d, w in zip(columns, means, dev, loadings)]
    return sum(terms[1:], terms[0])


def _first_by_sum(placed: DataFrame, query: str, item: str, columns: Sequence[str], top: int) -> DataFrame:
    """``placed`` with ``fused``, the sum of places, without the items that can't be among the ``top`` smallest sums of their query.

    Items are taken in the order of their component. The largest sum of the first ``top`` bounds the sums asked for, and as a place adds at most the
    largest weight of the component to the projection, an item whose projection lies above that bound's is left out: exactly, since places are 1 or more.
    """
    means, dev, loadings = first_component(placed, columns)
    weights = loadings / dev
    raw = _projection(columns, np.zeros(len(columns)), dev, loadings)
    scored = placed.select(query, item, sum((F.col(c) for c in columns[1:]), F.col(columns[0])).alias("fused"), raw.alias("__along"))
    rank = F.row_number().over(W.partitionBy(query).orderBy("__along", item))
    first = scored.withColumn("__k", rank).filter(F.col("__k") <= top)
    bound = first.groupBy(query).agg(F.max("fused").alias("__bound"), F.count(F.lit(1)).alias("__n"))
    near = F.col("__along") <= F.lit(float(weights.max()) * (1 + 1e-9)) * F.col("__bound")
    return scored.join(bound, query).filter(near | (F.col("__n") < top)).drop("__along", "__bound", "__n")


def fused_ranking(
    scores: DataFrame, runs: Sequence[str] | None = None, *, combine: str = "component", directions: Mapping[str, int] | None = None, top: int | None = None,
    query: str = "query_name", item: str = "docid", run: str = "run", score: str = "score",
) -> DataFrame:
    """``(query, item, fused, rank)``, one order per query in which every run has a say whatever its scale.

    Scores become places inside their run and query (see :func:`places`). combine='component' projects the standardised
    places on their first principal component over the whole table (fused: larger is better, rounded to 9 decimals);
    combine='sum' adds the places with equal loadings (fused: the sum, smaller is better); with ``top`` the component's order finds the
    candidates, exactly, and only those are ranked by their sums. Ties go to the smaller item. ``top`` keeps the first so many items of each query. ``runs`` defaults to the runs that occur. An empty table gives no row.
    """
    if runs is None:
        runs = sorted(r[0] for r in scores.select(run).distinct().collect() if r[0] is not None) or ["none"]
    placed = cut(places(scores, query, item, run, score, runs, directions), "places")
    columns = [f"p_{k}" for k in range(len(runs))]
    if combine == "sum" and top is not None:
        fused, order = _first_by_sum(placed, query, item, columns, top), F.col("fused").asc()
    elif combine == "sum":
        fused = placed.withColumn("fused", sum((F.col(c) for c in columns[1:]), F.col(columns[0])))
        order = F.col("fused").asc()
    elif combine == "component":
        fused = placed.withColumn("fused", F.round(-_projection(columns, *first_component(placed, columns)), 9))
        order = F.col("fused").desc()
    else:
        raise ValueError(f"combine: {combine}")
    if top is None:
        ranked = group_positions(fused, [query], [order, F.col(item).asc()], "rank")
    else:  # ranks above ``top`` are cut before the shuffle
        ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(order, F.col(item).asc()))).filter(F.col("rank") <= top)
    return ranked.select(query, item, "fused", F.col("rank").cast("int").alias("rank"))
