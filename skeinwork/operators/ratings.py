"""Clean ratings, their statistics, and the normalised matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEUTRAL = 3.0


def clean_ratings(log: DataFrame) -> DataFrame:
    """``(user_id, item_id, score, x, pos)`` of a log ``(pos, movieid, userid, score)``: valid ids and scores 1 to 5, the last line of a pair, x = score - 3."""
    score = F.col("score")
    valid = (F.col("movieid") > 0) & (F.col("userid") > 0) & score.isNotNull() & ~F.isnan(score) & score.between(1, 5)
    last = log.filter(valid).groupBy(F.col("userid").alias("user_id"), F.col("movieid").alias("item_id")).agg(F.max(F.struct("pos", "score")).alias("r"))
    return last.select("user_id", "item_id", F.col("r.score").alias("score"), (F.col("r.score") - NEUTRAL).alias("x"), F.col("r.pos").alias("pos"))


def _figures(prefix: str, condition: Column | None, with_counts: bool) -> list[Column]:
    own = F.lit(True) if condition is None else condition
    figures = [F.count_if(own & (F.col("score") == k)).alias(f"{prefix}_rated_{k}") for k in (1, 3, 5)]
    if with_counts:
        figures.append(F.count_if(own).alias(f"{prefix}_ratings"))
    return [*figures, F.avg(F.when(own, F.col("score"))).alias(f"{prefix}_average")]


def rating_stats(ratings: DataFrame, user_id: int, item_id: int) -> DataFrame:
    """One row of 16 figures: users and items, ratings of 1, 3 and 5 and averages, over all and for one user and one item."""
    counts = [F.count_distinct("item_id").alias("items"), F.count_distinct("user_id").alias("users")]
    return ratings.agg(*counts, *_figures("all", None, False), *_figures("user", F.col("user_id") == user_id, True), *_figures("item", F.col("item_id") == item_id, True))


def normalised(ratings: DataFrame, key: str, value: str = "x") -> DataFrame:
    """``ratings`` with ``unit``: ``value`` over the length of its row ``key``; rows of length 0 keep their zeros."""
    sizes = ratings.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("__size"))
    return ratings.join(sizes, key).withColumn("unit", F.when(F.col("__size") > 0, F.col(value) / F.col("__size")).otherwise(F.col(value))).drop("__size")


def standardised(ratings: DataFrame, *, as_written: bool = False) -> DataFrame:
    """``ratings`` with ``unit``: scores minus their item's mean, scaled to length 1 by item.

    ``as_written`` follows the original arithmetic: the sum of an item's scores over the rating count of the last line's
    item, a further 3 subtracted, and items whose imputed scores are all 0 left raw. The last line is that of the largest ``pos``, ties to the larger user, then item.
    """
    per_item = ratings.groupBy("item_id").agg(F.avg("score").alias("__mean"), F.sum("score").alias("__sum"), F.count(F.lit(1)).alias("__n"), F.max(F.abs("x")).alias("__live"))
    joined = ratings.join(per_item, "item_id")
    if as_written:
        last = ratings.agg(F.max_by("item_id", F.struct("pos", "user_id", "item_id")).alias("item_id"))
        count = per_item.join(last, "item_id").first()
        stale = float(count["__n"]) if count else 1.0
        centred = joined.withColumn("c", F.when(F.col("__live") > 0, F.col("score") - F.col("__sum") / stale - NEUTRAL).otherwise(F.col("x")))
    else:
        centred = joined.withColumn("c", F.col("score") - F.col("__mean"))
    centred = centred.drop("__mean", "__sum", "__n", "__live").withColumn("c", F.round("c", 12))
    return normalised(centred, "item_id", "c").drop("c")
