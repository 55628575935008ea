"""Queries on clusters of similar records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .clusters import describe, record_clusters


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    members, _, _ = record_clusters(table(spark, folder, "docvectors"))
    members = cut(members, "members")
    big = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 3).select("cluster_id")
    return members.join(big, "cluster_id", "left_semi").select("doc_id", "cluster_id")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    members, near, classes = record_clusters(table(spark, folder, "docvectors"))
    return describe(cut(members, "members"), near, classes)


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters}

SQL = {
    "p3_found": """
WITH RECURSIVE e AS (SELECT doc_id, term, CAST(sum(freq) AS DOUBLE) AS f FROM (SELECT DISTINCT * FROM docvectors) WHERE doc_id IS NOT NULL AND term IS NOT NULL AND freq > 0 GROUP BY doc_id, term),
     d AS (SELECT term FROM e GROUP BY term HAVING 5 * count(*) <= (SELECT count(DISTINCT doc_id) FROM e)),
     v AS MATERIALIZED (SELECT doc_id, term, f FROM e JOIN d USING (term)),
     n AS MATERIALIZED (SELECT doc_id, sum(f * f) AS q FROM v GROUP BY doc_id),
     l AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM v x JOIN v y ON x.term = y.term AND x.doc_id <> y.doc_id
           JOIN n p ON p.doc_id = x.doc_id JOIN n r ON r.doc_id = y.doc_id
           GROUP BY x.doc_id, y.doc_id, p.q, r.q HAVING 4 * sum(x.f * y.f) * sum(x.f * y.f) >= p.q * r.q),
     w(doc_id, reach) AS (SELECT a, a FROM l UNION SELECT l.b, w.reach FROM w JOIN l ON l.a = w.doc_id),
     c AS (SELECT doc_id, min(reach) AS cluster_id FROM w GROUP BY doc_id)
SELECT doc_id, cluster_id FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY cluster_id HAVING count(*) >= 3)
"""
}
