"""Clean ratings of a rating log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_rating() -> Column:
    score = F.col("score")
    return (F.col("movieid") > 0) & (F.col("userid") > 0) & score.isNotNull() & ~F.isnan(score) & score.between(1, 5)


def latest(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """For each of ``keys`` the row of the largest pos; null pos is smallest, and copies of one pos give the largest ``values``, in their order."""
    newest = F.max(F.struct("pos", *values))
    return rows.groupBy(*keys).agg(newest.alias("__r")).select(*keys, *(F.col(f"__r.{v}").alias(v) for v in values))
