"""Connected components of links by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``; ``component`` is one of the ids. Self-links and repeats do no harm.

    Every id points to the one of its neighbours and itself with the smallest hash; links are then drawn between the ids
    pointed to, until none is left. Hubs cost no more than other ids: minima are pre-aggregated and joins may be split.
    """
    edges = cut(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    levels: list[DataFrame] = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min_by("b", F.xxhash64("b"))
        points = both.groupBy("a").agg(least.alias("n"))
        points = cut(points.select(F.col("a").alias("id"), F.when(F.xxhash64("n") < F.xxhash64("a"), F.col("n")).otherwise(F.col("a")).alias("to")), "points")
        levels.append(points)
        x, y = points.select(F.col("id").alias("a"), F.col("to").alias("x")), points.select(F.col("id").alias("b"), F.col("to").alias("y"))
        drawn = edges.join(x, "a").join(y, "b").filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        before, edges = edges, cut(drawn, "links")
        drop_cut(before)
        if not edges.take(1):
            break
    labels = levels[0]
    for level in levels[1:]:
        step = level.select(F.col("id").alias("to"), F.col("to").alias("next"))
        labels = labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    return cut(labels.select("id", F.col("to").alias("component")), "components")
