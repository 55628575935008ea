"""Queries on users whose ratings agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .ratings import latest, valid_rating
from .similar import expand_classes, nearest, nearest_members, similar_pairs, to_vectors


def rating_vectors(spark: SparkSession, folder: str, *, least: int = 20) -> DataFrame:
    """Users with at least ``least`` clean ratings other than 3, as vectors of score - 3 by movie."""
    rows = table(spark, folder, "train").select("pos", "movieid", "userid", "score").filter(valid_rating())
    clean = latest(rows, ["movieid", "userid"], ["score"]).filter(F.col("score") != 3)
    return to_vectors(clean.withColumn("v", F.col("score") - 3), "userid", "movieid", "v", least=least)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, classes = similar_pairs(rating_vectors(spark, folder), min_similarity=0.8)
    return expand_classes(pairs, classes).select(F.col("a").alias("userid_a"), F.col("b").alias("userid_b"))


def p1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest other users, copies included and however dissimilar, of each user divisible by 20 with a clean rating other than 3, against all such users."""
    vectors = rating_vectors(spark, folder, least=1)
    asked = F.col("id") % 20 == 0
    neighbours, classes = nearest(vectors, 5, queries=vectors.filter(asked).select("id"))
    members = nearest_members(cut(neighbours, "neighbours"), classes, 5, asked)
    return members.select(F.col("id").alias("userid"), F.col("neighbour").alias("other"), F.round("similarity", 9).alias("similarity"), "rank")


QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest}

_VECTORS = """
WITH k AS (SELECT movieid, userid, score, row_number() OVER (PARTITION BY movieid, userid ORDER BY pos DESC NULLS LAST, score DESC) AS n
           FROM train WHERE movieid > 0 AND userid > 0 AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 1 AND 5),
     c AS (SELECT movieid, userid, score - 3 AS v FROM k WHERE n = 1 AND score <> 3),
     u AS (SELECT userid, sqrt(sum(v * v)) AS len, list((movieid, v) ORDER BY movieid) AS content FROM c GROUP BY userid HAVING count(*) >= 20)
"""

SQL = {
    "p1_found": _VECTORS
    + """, x AS (SELECT movieid, userid, v, len FROM c JOIN u USING (userid))
SELECT a.userid AS userid_a, b.userid AS userid_b FROM x a JOIN x b ON a.movieid = b.movieid AND a.userid < b.userid
GROUP BY a.userid, b.userid, a.len, b.len HAVING sum(a.v * b.v) / (a.len * b.len) >= 0.8 - 1e-12
""",
}
