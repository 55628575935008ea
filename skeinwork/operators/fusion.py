"""Fusion of retrieval scores with rank, and run rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUM_WEIGHT, HARMONIC_WEIGHT = 3.0, 0.99


def _ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def no_search(pg: Column, score: Column) -> Column:
    """ln of the rank; null at 0."""
    return _ln(pg)


def weighted_sum(pg: Column, score: Column, w: float = SUM_WEIGHT) -> Column:
    """ln((1 - w) * rank + w * exp(score)); null outside the logarithm's domain."""
    return _ln((1 - w) * pg + w * F.exp(score))


def harmonic(pg: Column, score: Column, w: float = HARMONIC_WEIGHT) -> Column:
    """1 / ((1 - w) / ln rank + w / score), the weighted harmonic mean of the logarithms; null where undefined."""
    return F.try_divide(F.lit(1.0), F.try_divide(F.lit(1 - w), _ln(pg)) + F.try_divide(F.lit(w), score))


FUSIONS = {"ns": no_search, "ws": weighted_sum, "cs": harmonic}


def fuse(relevance: DataFrame, rank: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """``(query_name, doc_id, score, rank)``: each list reordered by the fused score, descending, undefined last, ties to the smaller doc_id.

    ``rank`` has (doc_id, r), or (query_name, doc_id, r) for ranks by query; documents without one have rank 0.
    """
    keys = [c for c in ("query_name", "doc_id") if c in rank.columns]
    joined = relevance.select("query_name", "doc_id", F.col("score").alias("rv")).join(rank, keys, "left")
    scored = joined.select("query_name", "doc_id", F.round(combine(F.coalesce("r", F.lit(0.0)), F.col("rv")), 12).alias("score"))
    order = W.partitionBy("query_name").orderBy(F.col("score").desc_nulls_last(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order))


def run_lines(ranked: DataFrame, run: str) -> DataFrame:
    """``(query_name, rank, line)``: 'query Q0 doc rank score run'."""
    score = F.when(F.col("score").isNull(), "-inf").otherwise(F.format_string("%.6f", "score"))
    return ranked.select("query_name", "rank", F.concat_ws(" ", "query_name", F.lit("Q0"), "doc_id", "rank", score, F.lit(run)).alias("line"))
