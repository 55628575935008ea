"""Queries that write tables as lines of the text formats and parse them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text as T
from ..operators import topk
from ..sources import files
from ..session import table
from .graph_queries import _QD, _SALES, _distribution


def _ratings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "train").filter("movieid IS NOT NULL AND userid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return files.parse_ratings(rows.select("pos", F.concat_ws(",", "movieid", "userid", "score").alias("value")))


def _pairs(spark, folder):
    rows = table(spark, folder, "train").filter("movieid IS NOT NULL AND userid IS NOT NULL")
    return files.parse_pairs(rows.select("pos", F.concat_ws(",", "movieid", "userid").alias("value")))


def _vectors(spark, folder):
    tf = T.document_terms(table(spark, folder, "docvectors"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "tf"))), lambda e: F.concat_ws(":", e["term"], e["tf"])), " ")
    return files.parse_vectors(tf.groupBy(F.col("doc_id").alias("pos")).agg(line.alias("value")))


def _run(spark, folder):
    rows = table(spark, folder, "relevance").filter("score IS NOT NULL AND NOT isnan(score) AND abs(score) < double('inf') AND rank_no IS NOT NULL")
    return files.parse_run(rows.select(F.concat_ws(" ", "query_name", F.lit("Q0"), "docid", "rank_no", "score", "run").alias("value")))


def _topics(spark, folder):
    d = _distribution(spark, folder, False)
    listed = F.array_sort(F.collect_list(F.struct("topic_id", F.format_string("%.6f", "p").alias("p"))))
    return files.parse_distribution(d.groupBy("query_name").agg(listed.alias("l")).select(_line("l", "query_name").alias("value")))


def _line(listed: str, name: str):
    return F.concat(F.regexp_replace(name, "-", " "), F.lit(" "), F.array_join(F.transform(listed, lambda e, k: F.concat((k + 1).cast("string"), F.lit(":"), e["p"])), " "))


def _positions(spark, folder):
    return topk.positions(table(spark, folder, "documents").select("doc_id"), ["doc_id"])


QUERIES = {
    "parse_ratings_csv": _ratings,
    "parse_query_pairs": _pairs,
    "parse_doc_vectors": _vectors,
    "parse_trec_run": _run,
    "parse_topic_distribution": _topics,
    "line_positions": _positions,
    "first_appearance": lambda s, d: topk.first_appearance(table(s, d, "train"), "movieid"),
    "last_write_wins": lambda s, d: topk.last_write(table(s, d, "train").filter("movieid IS NOT NULL AND userid IS NOT NULL AND NOT isnan(score)"), ["movieid", "userid"], "score"),
}

SQL = {
    "parse_ratings_csv": "SELECT pos, movieid AS item_id, userid AS user_id, score FROM train WHERE movieid IS NOT NULL AND userid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)",
    "parse_query_pairs": "SELECT pos, movieid AS item_id, userid AS user_id FROM train WHERE movieid IS NOT NULL AND userid IS NOT NULL",
    "parse_doc_vectors": "SELECT doc_id, term, CAST(sum(freq) AS INT) AS tf FROM (SELECT DISTINCT * FROM docvectors) WHERE doc_id IS NOT NULL AND term IS NOT NULL AND freq > 0 GROUP BY doc_id, term",
    "parse_trec_run": "SELECT query_name, docid AS doc_id, rank_no AS rank, score, run FROM relevance WHERE score IS NOT NULL AND isfinite(score) AND rank_no IS NOT NULL AND docid IS NOT NULL",
    "parse_topic_distribution": f"WITH {_SALES}, {_QD} SELECT query_name, CAST(split_part(query_name, '-', 1) AS INT) AS user_id, 1 AS query_id, CAST(row_number() OVER (PARTITION BY query_name ORDER BY topic_id) AS INT) AS topic_id, round(p, 6) AS p FROM dq",
    "line_positions": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents",
    "first_appearance": "SELECT movieid, min(pos) AS first FROM train GROUP BY movieid",
    "last_write_wins": "SELECT movieid, userid, score FROM (SELECT movieid, userid, score, row_number() OVER (PARTITION BY movieid, userid ORDER BY pos DESC NULLS LAST, score DESC NULLS LAST) AS k FROM train WHERE movieid IS NOT NULL AND userid IS NOT NULL AND (score IS NULL OR NOT isnan(score))) WHERE k = 1",
}
