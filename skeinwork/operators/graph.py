"""Link analysis: transition weights, teleport vectors, global and topic-sensitive rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, drop_cut

DAMPING, TOPIC_SHARE, ITERATIONS = 0.8, 0.99, 10
#: Iterations between written tables.
CUT_EVERY = 5


def transition(edges: DataFrame) -> DataFrame:
    """``(src, dst, w)`` of raw ``edges(src, dst)``: w = 1 / (1 + raw out-lines), repeated lines giving one cell, and a loop of that weight on every node in any edge."""
    raw = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    lines = raw.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = lines.groupBy("src").agg(F.sum("n").alias("out"))
    nodes = lines.select("src").unionByName(lines.select(F.col("dst").alias("src"))).distinct()
    weights = nodes.join(out, "src", "left").select("src", (F.lit(1.0) / (F.coalesce("out", F.lit(0)) + 1)).alias("w"))
    cells = lines.filter("src <> dst").select("src", "dst").join(weights, "src").select("src", "dst", "w")
    return cells.unionByName(weights.select("src", F.col("src").alias("dst"), "w"))


def teleport(cells: DataFrame, total: int) -> DataFrame:
    """``(doc_id, p)``: 1 / ``total`` on each node in any edge (those with a loop)."""
    return cells.filter("src = dst").select(F.col("src").alias("doc_id"), F.lit(1.0 / total).alias("p"))


def topic_matrix(doc_topics: DataFrame) -> DataFrame:
    """``(doc_id, topic_id, p)``: 1 / size of the topic for each of its documents."""
    rows = doc_topics.select("doc_id", "topic_id").filter("doc_id IS NOT NULL AND topic_id IS NOT NULL").distinct()
    sizes = rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, "topic_id").select("doc_id", "topic_id", (F.lit(1.0) / F.col("n")).alias("p"))


def rank_vectors(cells: DataFrame, p0: DataFrame, targets: DataFrame | None, names: Sequence, *, damping: float = DAMPING, share: float = TOPIC_SHARE, iterations: int = ITERATIONS) -> DataFrame:
    """``(doc_id, r_0 ... r_k)``, one rank a name of ``names`` of ``targets(doc_id, topic_id, p)``, or one global rank without targets.

    r becomes damping * T'r + (1 - damping) * ((1 - share) * p0 + share * target), ``iterations`` times from p0. All ranks move together, so every
    iteration joins the edges once, whatever their number.
    """
    share = share if targets is not None else 0.0
    nodes = p0.select("doc_id", F.col("p").alias("p0"))
    if targets is not None:
        wide = targets.groupBy("doc_id").agg(*(F.sum(F.when(F.col("topic_id") == name, F.col("p"))).alias(f"t_{k}") for k, name in enumerate(names)))
        nodes = nodes.join(wide, "doc_id", "full")
        names = list(names)
    else:
        names, nodes = [None], nodes.withColumn("t_0", F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = cut(nodes.select("doc_id", zero("p0").alias("p0"), *((F.lit(1 - damping) * (F.lit(1 - share) * zero("p0") + F.lit(share) * zero(f"t_{k}"))).alias(f"b_{k}") for k in range(len(names)))), "base")
    edges = cut(cells, "edges")
    rank = base.select("doc_id", *(F.col("p0").alias(f"r_{k}") for k in range(len(names))))
    previous = None
    for i in range(iterations):
        moved = edges.join(rank, F.col("src") == F.col("doc_id")).groupBy("dst").agg(*(F.sum(F.col("w") * F.col(f"r_{k}")).alias(f"s_{k}") for k in range(len(names))))
        rank = base.join(moved, F.col("doc_id") == F.col("dst"), "left").select("doc_id", *((F.lit(damping) * zero(f"s_{k}") + F.col(f"b_{k}")).alias(f"r_{k}") for k in range(len(names))))
        if (i + 1) % CUT_EVERY == 0 and i + 1 < iterations:
            rank = cut(rank, "rank")
            drop_cut(previous)
            previous = rank
    return rank


def global_rank(cells: DataFrame, p0: DataFrame, **options) -> DataFrame:
    """``(doc_id, r)``."""
    return rank_vectors(cells, p0, None, [None], **options).withColumnRenamed("r_0", "r")


def topic_ranks(cells: DataFrame, p0: DataFrame, topics: DataFrame, names: Sequence, **options) -> DataFrame:
    """``(topic_id, doc_id, r)`` for each of ``names``."""
    wide = rank_vectors(cells, p0, topics, names, **options)
    pairs = F.array(*(F.struct(F.lit(name).alias("topic_id"), F.col(f"r_{k}").alias("r")) for k, name in enumerate(names)))
    return wide.select("doc_id", F.explode(pairs).alias("x")).select("x.topic_id", "doc_id", "x.r")


def mixed_rank(ranks: DataFrame, distribution: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(query_name, doc_id, r)``: topic ranks weighted by ``distribution(query_name, topic_id, p)``; the topic ranks are computed once for all queries.

    ``pairs(query_name, doc_id)`` limits the result to the listed documents of each query: those meet their ranks by document, and only then the distribution by query and
    topic, so nothing is made for unlisted ones. Without it every query has every ranked document.
    """
    distribution = cut(distribution.select("query_name", "topic_id", "p"), "distribution")
    small = broadcast_if_small(distribution, distribution.count(), 64)
    if pairs is None:
        met = ranks.join(small, "topic_id")
    else:
        met = pairs.select("query_name", "doc_id").distinct().join(ranks, "doc_id").join(small, ["query_name", "topic_id"])
    return met.groupBy("query_name", "doc_id").agg(F.sum(F.col("p") * F.col("r")).alias("r"))
