"""Queries for keys that hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import heavy_keys, key_profile
from ..session import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "train"), ["movieid", "userid"]).select("key_kind", "key_id")


def _profile(kind: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return key_profile(table(spark, folder, "train"), kind, order="pos", value="score").select(
            "key_id", "n", F.nanvl("first_value", F.lit(None).cast("double")).alias("first_value"), F.nanvl("last_value", F.lit(None).cast("double")).alias("last_value"), "changes"
        )

    return query


QUERIES = {"p7_found": p7_found, "p7_movie_profile": _profile("movieid"), "p7_user_profile": _profile("userid")}

_PROFILE = """
WITH r AS (SELECT DISTINCT {k} AS key_id, pos, score FROM train WHERE {k} IS NOT NULL),
     s AS (SELECT key_id, pos, score, lag(score) OVER w AS before, row_number() OVER w AS rn, row_number() OVER (PARTITION BY key_id ORDER BY pos DESC, score DESC NULLS LAST) AS back
           FROM r WINDOW w AS (PARTITION BY key_id ORDER BY pos, score NULLS FIRST))
SELECT key_id, count(*) AS n,
       max(CASE WHEN rn = 1 AND NOT isnan(score) THEN score END) AS first_value,
       max(CASE WHEN back = 1 AND NOT isnan(score) THEN score END) AS last_value,
       CAST(sum(CASE WHEN rn > 1 AND score IS DISTINCT FROM before THEN 1 ELSE 0 END) AS BIGINT) AS changes
FROM s GROUP BY key_id
"""

SQL = {
    "p7_found": """
WITH d AS (SELECT DISTINCT * FROM train), t AS (SELECT count(*) AS n FROM d),
     k AS (SELECT 'movieid' AS key_kind, movieid AS key_id, count(*) AS n FROM d GROUP BY movieid
           UNION ALL SELECT 'userid', userid, count(*) FROM d GROUP BY userid)
SELECT key_kind, key_id FROM k, t WHERE key_id > 0 AND k.n * 100 >= t.n
""",
    "p7_movie_profile": _PROFILE.format(k="movieid"),
    "p7_user_profile": _PROFILE.format(k="userid"),
}
