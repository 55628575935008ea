"""Queries on term statistics and term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .fuse import fused_ranking
from .terms import term_counts, term_weights
from .topn import top_n
from .ratings import valid_rating
from .words import word_sql


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    counts = term_counts(table(spark, folder, "docvectors"), table(spark, folder, "documents"))
    return counts.filter(F.col("mark").isNotNull()).select("fieldname", "term", "mark")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts(table(spark, folder, "docvectors"), table(spark, folder, "documents"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "train").filter(valid_rating())
    return top_n(rows, "movieid", "userid", "score", 5, recent="rated_at", latest_by="pos").select("movieid", "userid")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_weights(table(spark, folder, "docvectors"), table(spark, folder, "documents")).select("fieldname", "doc_id", "term")


def p5_graph(spark: SparkSession, folder: str) -> DataFrame:
    return term_weights(table(spark, folder, "docvectors"), table(spark, folder, "documents"), measure="degree")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return fused_ranking(table(spark, folder, "relevance"), combine="sum", top=10).select("query_name", "docid")


def p6_component(spark: SparkSession, folder: str) -> DataFrame:
    return fused_ranking(table(spark, folder, "relevance"))


QUERIES = {
    "p2_found": p2_found, "p2_counts": p2_counts, "p4_found": p4_found, "p5_found": p5_found, "p5_graph": p5_graph,
    "p6_found": p6_found, "p6_component": p6_component,
}

_COUNTS = f"""
WITH e AS (SELECT doc_id, term, sum(freq) AS f FROM (SELECT DISTINCT * FROM docvectors) WHERE term IS NOT NULL AND freq > 0 AND doc_id IS NOT NULL GROUP BY doc_id, term),
     w AS (SELECT doc_id, unnest({word_sql("text")}) AS term FROM documents),
     c AS (SELECT 'docvectors' AS fieldname, CAST(term AS VARCHAR) AS term, CAST(sum(f) AS BIGINT) AS total, count(*) AS records FROM e GROUP BY term
           UNION ALL SELECT 'text', term, count(*), count(DISTINCT doc_id) FROM w GROUP BY term),
     n AS (SELECT 'docvectors' AS fieldname, count(DISTINCT doc_id) AS n_records FROM e UNION ALL SELECT 'text', count(DISTINCT doc_id) FROM w),
     m AS (SELECT fieldname, term, total, records, n_records, CASE WHEN records < 3 THEN 'rare' WHEN 5 * records > n_records THEN 'common' END AS mark FROM c JOIN n USING (fieldname))
"""

SQL = {
    "p2_found": _COUNTS + "SELECT fieldname, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_counts": _COUNTS + "SELECT fieldname, term, total, records, n_records, mark FROM m",
}

SQL["p4_found"] = """
WITH c AS (SELECT movieid, userid, score, rated_at, row_number() OVER (PARTITION BY movieid, userid ORDER BY pos DESC NULLS LAST, score DESC, rated_at DESC NULLS LAST) AS k
           FROM train WHERE movieid > 0 AND userid > 0 AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 1 AND 5),
     r AS (SELECT movieid, userid, row_number() OVER (PARTITION BY movieid ORDER BY score DESC, rated_at DESC NULLS LAST, userid) AS n FROM c WHERE k = 1)
SELECT movieid, userid FROM r WHERE n <= 5
"""

SQL["p5_found"] = _COUNTS.rstrip() + """,
     f AS (SELECT 'docvectors' AS fieldname, doc_id, CAST(term AS VARCHAR) AS term, term AS number, CAST(f AS BIGINT) AS f FROM e
           UNION ALL SELECT 'text', doc_id, term, NULL, count(*) FROM w GROUP BY doc_id, term),
     x AS (SELECT fieldname, doc_id, term, number, round(f * ln(1 + n_records / records), 6) AS weight FROM f JOIN m USING (fieldname, term)),
     k AS (SELECT fieldname, doc_id, term, row_number() OVER (PARTITION BY fieldname, doc_id ORDER BY weight DESC, number, term) AS n FROM x)
SELECT fieldname, doc_id, term FROM k WHERE n <= 3
"""

_PLACES = """
WITH s AS (SELECT query_name, docid, run, max(score) AS s FROM relevance WHERE query_name IS NOT NULL AND docid IS NOT NULL AND run IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY ALL),
     p AS (SELECT query_name, docid, run, row_number() OVER (PARTITION BY query_name, run ORDER BY s DESC, docid) AS p FROM s),
     c AS (SELECT query_name, run, count(*) AS n FROM s GROUP BY ALL),
     q AS (SELECT DISTINCT query_name, docid FROM s),
     a AS (SELECT q.query_name, q.docid, u.run, coalesce(p.p, c.n + 1, 1) AS p
           FROM q CROSS JOIN (SELECT DISTINCT run FROM relevance WHERE run IS NOT NULL) u
           LEFT JOIN p ON p.query_name = q.query_name AND p.docid = q.docid AND p.run = u.run
           LEFT JOIN c ON c.query_name = q.query_name AND c.run = u.run)
"""

SQL["p6_found"] = _PLACES + """,
     t AS (SELECT query_name, docid, row_number() OVER (PARTITION BY query_name ORDER BY sum(p), docid) AS n FROM a GROUP BY query_name, docid)
SELECT query_name, docid FROM t WHERE n <= 10
"""

SQL["p5_graph"] = _COUNTS.rstrip() + f""",
     t AS (SELECT 'docvectors' AS fieldname, doc_id, CAST(term AS VARCHAR) AS term, term AS number, row_number() OVER (PARTITION BY doc_id ORDER BY pos, term) AS k
           FROM (SELECT DISTINCT doc_id, pos, term FROM docvectors WHERE doc_id IS NOT NULL AND pos IS NOT NULL AND term IS NOT NULL AND freq > 0)
           UNION ALL SELECT 'text', doc_id, l[k], NULL, k FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, {word_sql("text")} AS l FROM documents WHERE text IS NOT NULL))),
     g AS (SELECT a.fieldname, a.doc_id, a.term AS a, b.term AS b FROM t a JOIN t b ON a.fieldname = b.fieldname AND a.doc_id = b.doc_id AND b.k BETWEEN a.k + 1 AND a.k + 3 AND a.term <> b.term),
     d AS (SELECT fieldname, doc_id, term, count(DISTINCT o) AS d FROM (SELECT fieldname, doc_id, a AS term, b AS o FROM g UNION ALL SELECT fieldname, doc_id, b, a FROM g) GROUP BY ALL),
     x AS (SELECT u.fieldname, u.doc_id, u.term, number, round(coalesce(d, 0) * ln(1 + n_records / records), 6) AS weight
           FROM (SELECT DISTINCT fieldname, doc_id, term, number FROM t) u JOIN m USING (fieldname, term) LEFT JOIN d ON d.fieldname = u.fieldname AND d.doc_id = u.doc_id AND d.term = u.term),
     k AS (SELECT fieldname, doc_id, term, weight, row_number() OVER (PARTITION BY fieldname, doc_id ORDER BY weight DESC, number, term) AS n FROM x)
SELECT fieldname, doc_id, term, weight, CAST(n AS INT) AS rank FROM k WHERE n <= 3
"""

# the first component by repeated multiplication with the correlation matrix
SQL["p6_component"] = "WITH RECURSIVE " + _PLACES.strip().removeprefix("WITH ") + """,
     z AS MATERIALIZED (SELECT query_name, docid, run, p, avg(p) OVER (PARTITION BY run) AS m, stddev_pop(p) OVER (PARTITION BY run) AS d FROM a),
     rho AS MATERIALIZED (SELECT x.run AS i, y.run AS j, avg((x.p - x.m) / x.d * ((y.p - y.m) / y.d)) AS r FROM z x JOIN z y ON x.query_name = y.query_name AND x.docid = y.docid GROUP BY ALL),
     w(n, i, v) AS (SELECT DISTINCT 0, i, CAST(1 AS DOUBLE) FROM rho
           UNION ALL SELECT n + 1, i, v / sqrt(sum(v * v) OVER ()) FROM (SELECT any_value(w.n) AS n, c.i, sum(c.r * w.v) AS v FROM w JOIN rho c ON c.j = w.i WHERE w.n < 300 GROUP BY c.i)),
     l AS (SELECT i AS run, abs(v) AS v FROM w WHERE n = 300),
     f AS (SELECT query_name, docid, round(-sum(v * (p - m) / d), 9) AS fused FROM z JOIN l USING (run) GROUP BY query_name, docid)
SELECT query_name, docid, fused, CAST(row_number() OVER (PARTITION BY query_name ORDER BY fused DESC, docid) AS INT) AS rank FROM f
"""
