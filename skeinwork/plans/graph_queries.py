"""Queries on the graph of parts ordered one after the other: ranks by topic (part type), nation and region, fused with revenue lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fusion, graph
from ..session import cut, table

LIST = 500


def edges(spark: SparkSession, folder: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).filter("dst IS NOT NULL")


def _sales(spark, folder):
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return l.join(o, "l_orderkey").join(c, "c_custkey").join(F.broadcast(n), "c_nationkey").join(p, "l_partkey")  # nation: 25 rows


def _topics(spark, folder):
    return graph.topic_matrix(table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("topic_id")))


def _distribution(spark, folder, personal: bool):
    s = _sales(spark, folder)
    if not personal:
        by = s.groupBy(F.concat("c_nationkey", F.lit("-1")).alias("query_name"), F.col("p_type").alias("topic_id")).agg(F.sum("l_quantity").alias("q"))
    else:
        region = s.groupBy("n_regionkey", F.col("p_type").alias("topic_id")).agg(F.sum("l_quantity").alias("q"))
        nations = table(spark, folder, "nation").select(F.concat("n_nationkey", F.lit("-1")).alias("query_name"), "n_regionkey")
        by = region.join(F.broadcast(nations), "n_regionkey")  # 25 rows
    return by.withColumn("p", F.col("q") / F.sum("q").over(W.partitionBy("query_name"))).select("query_name", "topic_id", "p")


def _relevance(spark, folder):
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    s = _sales(spark, folder).groupBy("c_nationkey", F.col("l_partkey").alias("doc_id")).agg(F.sum(value).alias("v"))
    share = F.round(F.log(F.col("v") / F.sum("v").over(W.partitionBy("c_nationkey"))), 9)
    scored = s.select(F.concat("c_nationkey", F.lit("-1")).alias("query_name"), "doc_id", share.alias("score"))
    rank = F.row_number().over(W.partitionBy("query_name").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("k", rank).filter(F.col("k") <= LIST).drop("k")


def _graph(spark, folder):
    cells = cut(graph.transition(edges(spark, folder)), "cells")
    return cells, graph.teleport(cells, table(spark, folder, "part").count())


def _topic_ranks(spark, folder):
    topics = _topics(spark, folder)
    names = sorted(r[0] for r in topics.select("topic_id").distinct().collect())  # part types, a fixed few
    return graph.topic_ranks(*_graph(spark, folder), topics, names)


def _rank(spark, folder, kind: str, pairs: DataFrame | None = None):
    if kind == "global":
        return graph.global_rank(*_graph(spark, folder))
    return graph.mixed_rank(_topic_ranks(spark, folder), _distribution(spark, folder, kind == "personal"), pairs)


def _rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _fuse(spark, folder, name: str, kind: str):
    lists = cut(_relevance(spark, folder), "lists")
    return fusion.fuse(lists, _rounded(_rank(spark, folder, kind, lists), "r", places=12), fusion.FUSIONS[name])


def _fused(name: str, kind: str):
    return lambda spark, folder: _rounded(_fuse(spark, folder, name, kind), "score", places=6)


def _run_file(spark, folder):
    return fusion.run_lines(_rounded(_fuse(spark, folder, "cs", "query"), "score", places=6), "qtspr-cs").select("query_name", "rank", "line")


QUERIES = {
    "transition_weights": lambda s, d: _rounded(graph.transition(edges(s, d)), "w"),
    "teleport": lambda s, d: graph.teleport(*_graph(s, d)[:1], table(s, d, "part").count()).withColumn("p", F.round("p", 9)),
    "topic_matrix": lambda s, d: _rounded(_topics(s, d), "p"),
    "query_distribution": lambda s, d: _rounded(_distribution(s, d, False), "p"),
    "retrieval_lists": lambda s, d: _rounded(_relevance(s, d), "score", places=6),
    "pagerank_global": lambda s, d: _rounded(_rank(s, d, "global"), "r"),
    "pagerank_topic": lambda s, d: _rounded(_topic_ranks(s, d), "r"),
    "pagerank_query": lambda s, d: _rounded(_rank(s, d, "query"), "r"),
    "pagerank_personal": lambda s, d: _rounded(_rank(s, d, "personal"), "r"),
    **{f"fuse_{n}_{k}": _fused(n, k) for n in ("ns", "ws", "cs") for k in ("global", "query", "personal")},
    "run_file": _run_file,
}

_CELLS = """
raw AS MATERIALIZED (SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL),
wt AS (SELECT n AS src, 1.0 / (1 + coalesce(c, 0)) AS w FROM (SELECT src AS n FROM raw UNION SELECT dst FROM raw) LEFT JOIN (SELECT src, count(*) AS c FROM raw GROUP BY src) ON n = src),
cells AS MATERIALIZED (SELECT src, dst, CAST(w AS DOUBLE) AS w FROM (SELECT DISTINCT src, dst FROM raw WHERE src <> dst) JOIN wt USING (src) UNION ALL SELECT src, src, CAST(w AS DOUBLE) FROM wt),
p0 AS (SELECT src AS doc_id, CAST(1 AS DOUBLE) / (SELECT count(*) FROM part) AS p FROM wt),
tm AS (SELECT p_partkey AS doc_id, p_type AS topic_id, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY p_type) AS p FROM part)"""


def _iterations(base: str, keys: str) -> str:
    steps = [f"base AS MATERIALIZED ({base})", f"r0 AS (SELECT {keys}, p0 AS r FROM base)"]
    on = " AND ".join(f"b.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    moved_keys = keys.replace("doc_id", "dst AS doc_id")
    for i in range(1, 11):
        steps.append(f"r{i} AS MATERIALIZED (SELECT {', '.join('b.' + k.strip() for k in keys.split(','))}, 0.8 * coalesce(m.s, 0) + b.b AS r FROM base b LEFT JOIN (SELECT {moved_keys}, sum(w * r) AS s FROM r{i - 1} JOIN cells ON src = doc_id GROUP BY ALL) m ON {on})")
    return ",\n".join(steps)


_GLOBAL = "WITH" + _CELLS + ",\n" + _iterations("SELECT doc_id, p AS p0, 0.2 * p AS b FROM p0", "doc_id")
_TOPIC = "WITH" + _CELLS + ",\n" + _iterations(
    """SELECT t.topic_id, n.doc_id, coalesce(p0.p, 0) AS p0, (1 - 0.8) * ((1 - 0.99) * coalesce(p0.p, 0) + 0.99 * coalesce(tm.p, 0)) AS b
  FROM (SELECT DISTINCT topic_id FROM tm) t CROSS JOIN (SELECT doc_id FROM p0 UNION SELECT doc_id FROM tm) n LEFT JOIN p0 USING (doc_id) LEFT JOIN tm ON tm.doc_id = n.doc_id AND tm.topic_id = t.topic_id""",
    "topic_id, doc_id",
)
_SALES = "sales AS (SELECT c_nationkey, n_regionkey, p_type, l_partkey, l_quantity, l_extendedprice * (1 - l_discount) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"
_QD = "dq AS (SELECT c_nationkey || '-1' AS query_name, p_type AS topic_id, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY c_nationkey) AS p FROM sales GROUP BY c_nationkey, p_type)"
_UD = "du AS (SELECT n.n_nationkey || '-1' AS query_name, topic_id, p FROM nation n JOIN (SELECT n_regionkey, p_type AS topic_id, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY n_regionkey) AS p FROM sales GROUP BY n_regionkey, p_type) USING (n_regionkey))"
_REL = f"rel AS (SELECT query_name, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY score DESC, doc_id) AS k FROM (SELECT c_nationkey || '-1' AS query_name, l_partkey AS doc_id, round(ln(sum(v) / sum(sum(v)) OVER (PARTITION BY c_nationkey)), 9) AS score FROM sales GROUP BY c_nationkey, l_partkey)) WHERE k <= {LIST})"


def _mixed_sql(d: str) -> str:
    return f"{_TOPIC}, {_SALES}, {_QD}, {_UD}, mix AS (SELECT query_name, doc_id, sum({d}.p * r) AS r FROM r10 JOIN {d} USING (topic_id) GROUP BY ALL)"


_FORMS = {
    "ns": "CASE WHEN pg > 0 THEN ln(pg) END",
    "ws": "CASE WHEN -2.0 * pg + 3.0 * exp(rv) > 0 THEN ln(-2.0 * pg + 3.0 * exp(rv)) END",
    "cs": "CASE WHEN pg > 0 THEN 1.0 / (0.01 / nullif(ln(pg), 0) + 0.99 / nullif(rv, 0)) END",
}


def _fused_sql(name: str, kind: str) -> str:
    head = f"{_GLOBAL}, {_SALES}" if kind == "global" else _mixed_sql("dq" if kind == "query" else "du")
    source, on = ("r10", "r.doc_id = rel.doc_id") if kind == "global" else ("mix", "r.doc_id = rel.doc_id AND r.query_name = rel.query_name")
    return f"""{head}, {_REL}, x AS (SELECT rel.query_name, rel.doc_id, coalesce(round(r.r, 12), 0) AS pg, rel.score AS rv FROM rel LEFT JOIN {source} r ON {on}),
f AS (SELECT query_name, doc_id, round({_FORMS[name]}, 12) AS score FROM x),
k AS (SELECT query_name, doc_id, score, row_number() OVER (PARTITION BY query_name ORDER BY score DESC NULLS LAST, doc_id) AS rank FROM f)"""


SQL = {
    "transition_weights": "WITH" + _CELLS + " SELECT src, dst, round(w, 9) AS w FROM cells",
    "teleport": "WITH" + _CELLS + " SELECT doc_id, round(p, 9) AS p FROM p0",
    "topic_matrix": "SELECT p_partkey AS doc_id, p_type AS topic_id, round(1 / count(*) OVER (PARTITION BY p_type), 9) AS p FROM part",
    "query_distribution": f"WITH {_SALES}, {_QD} SELECT query_name, topic_id, round(p, 9) AS p FROM dq",
    "retrieval_lists": f"WITH {_SALES}, {_REL} SELECT query_name, doc_id, round(score, 6) AS score FROM rel",
    "pagerank_global": f"{_GLOBAL} SELECT doc_id, round(r, 9) AS r FROM r10",
    "pagerank_topic": f"{_TOPIC} SELECT topic_id, doc_id, round(r, 9) AS r FROM r10",
    "pagerank_query": f"{_mixed_sql('dq')} SELECT query_name, doc_id, round(r, 9) AS r FROM mix",
    "pagerank_personal": f"{_mixed_sql('du')} SELECT query_name, doc_id, round(r, 9) AS r FROM mix",
    **{f"fuse_{n}_{k}": f"{_fused_sql(n, k)} SELECT query_name, doc_id, round(score, 6) AS score, rank FROM k" for n in ("ns", "ws", "cs") for k in ("global", "query", "personal")},
    "run_file": f"{_fused_sql('cs', 'query')} SELECT query_name, rank, query_name || ' Q0 ' || doc_id || ' ' || rank || ' ' || coalesce(printf('%.6f', round(score, 6)), '-inf') || ' qtspr-cs' AS line FROM k",
}
